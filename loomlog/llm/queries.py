"""The registered queries of this subpackage and their SQL."""

from . import ann, decontam, linededup, packing, quality, secrets, simhash, suffix, toxicity, warc

QUERIES = {
    "op1_line_dedup": linededup.query,
    "op2_decontamination": decontam.query,
    "op3_packing": packing.query,
    "op4_toxicity": toxicity.query,
    "op5_warc": warc.query,
    "op6_secrets": secrets.query,
    "op7_suffix": suffix.query,
    "op8_simhash": simhash.query,
    "op9_quality": quality.query,
    "op10_ann": ann.query,
}

ORACLES: dict[str, str] = {
    "op1_line_dedup": linededup.ORACLE,
    "op5_warc": warc.ORACLE,
}
