"""Registered queries of the subpackage: name to query and DuckDB SQL (None where SQL can't)."""

from gridloom.llm import (
    centroids,
    conversations,
    decontaminate,
    html_text,
    jaccard,
    lines,
    mixing,
    repeats,
    secret_scan,
    tokens,
    topk,
    toxicity,
    warc,
)

QUERIES = {
    "op1_toxicity": (toxicity.op1_toxicity, None),
    "op2_mix_sources": (mixing.op2_mix_sources, mixing.OP2_SQL),
    "op3_top_k": (topk.op3_top_k, topk.OP3_SQL),
    "op4_jaccard_join": (jaccard.op4_jaccard_join, None),
    "op5_line_dedup": (lines.op5_line_dedup, lines.OP5_SQL),
    "op6_secrets": (secret_scan.op6_secrets, None),
    "op7_decontaminate": (decontaminate.op7_decontaminate, None),
    "op8_token_ids": (tokens.op8_token_ids, None),
    "op9_suffix_dedup": (repeats.op9_suffix_dedup, None),
    "op10_main_text": (html_text.op10_main_text, None),
    "op11_repair": (conversations.op11_repair, None),
    "op12_clusters": (centroids.op12_clusters, centroids.OP12_SQL),
    "op13_archives": (warc.op13_archives, warc.OP13_SQL),
}
