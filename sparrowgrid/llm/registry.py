"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .bpe import bpe
from .centroids import ORACLE as CLUSTER_SQL
from .centroids import centroid_clusters
from .decontam import decontaminate
from .htmlmain import html_extraction
from .kdsearch import ORACLE as SEARCH_SQL
from .kdsearch import exact_search
from .kdshard import kd_sharding
from .langid import language_id
from .simhash import simhash_dedup
from .spelling import spelling_variants
from .tokencount import token_counts
from .toxicity import toxicity
from .urlgraph import ORACLE as URL_SQL
from .urlgraph import url_filter
from .warc import warc_derivatives


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_decontamination": decontaminate,
        "op2_warc_derivatives": warc_derivatives,
        "op3_bpe": bpe,
        "op4_exact_search": exact_search,
        "op5_simhash_dedup": simhash_dedup,
        "op6_url_filter": url_filter,
        "op7_language_id": language_id,
        "op8_kd_sharding": kd_sharding,
        "op9_html_extraction": html_extraction,
        "op10_toxicity": toxicity,
        "op11_spelling_variants": spelling_variants,
        "op12_token_counts": token_counts,
        "op13_centroid_clusters": centroid_clusters,
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_exact_search": SEARCH_SQL, "op6_url_filter": URL_SQL, "op13_centroid_clusters": CLUSTER_SQL}
