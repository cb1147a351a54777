"""SQL surface of a catalog: ``parse_log(content)`` and the table function ``log_fields(content)``."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import pandas_udf, udtf

from ..operators import match
from ..plans.catalog import Catalog

PARSED = "array<struct<template_id:int,fields:array<struct<node_id:int,value:string>>>>"


def register(spark: SparkSession, catalog: Catalog, prefix: str = "") -> None:
    """Register both for SQL; ``match.parse`` is faster where a DataFrame is at hand."""

    @pandas_udf(PARSED)
    def parse_log(content):
        walk = match.Walker(catalog)
        return content.map(lambda x: [{"template_id": m["template_id"], "fields": m["fields"]} for m in walk(x)[0]])

    class LogFields:
        def __init__(self):
            self.walk = match.Walker(catalog)

        def eval(self, content: str):
            for m in self.walk(content)[0]:
                for f in m["fields"]:
                    yield m["template_id"], f["node_id"], f["value"]

    spark.udf.register(f"{prefix}parse_log", parse_log)
    spark.udtf.register(f"{prefix}log_fields", udtf(LogFields, returnType="template_id int, node_id int, value string"))
