"""The queries of the corpus operators and the SQL of those that SQL can express."""

from utterloom.llm import lines, minhash, mixing, packing, perplexity, pii, sharding, syncmers, url_filter, warc

QUERIES = {
    "op1_syncmers": syncmers.op1_syncmers,
    "op2_perplexity": perplexity.op2_perplexity,
    "op3_warc": warc.op3_warc,
    "op4_mixing": mixing.op4_mixing,
    "op5_lines": lines.op5_lines,
    "op6_url_filter": url_filter.op6_url_filter,
    "op7_minhash": minhash.op7_minhash,
    "op8_sharding": sharding.op8_sharding,
    "op9_packing": packing.op9_packing,
    "op10_pii": pii.op10_pii,
}
ORACLES = {"op3_warc": warc.ORACLE, "op6_url_filter": url_filter.ORACLE, "op7_minhash": minhash.ORACLE}
