"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

The derived tables are written as Parquet first, so that a query's time is its own
scan, joins and aggregates. Each query runs once to warm up and is then timed; its
rows are all computed and dropped (noop sink).
"""

import json
import os
import sys
import tempfile
import time
from pathlib import Path

from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent))

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
ENGINE = [
    "browse_gene", "filter_cadd_bands", "filter_known_delimited", "filter_known_array", "browse_gene_filtered", "browse_pdb", "join_cadd_left", "join_am_left", "join_popeve_twohop",
    "batch_scores_long", "filter_interact", "filter_feature_groups", "strategy2_features", "strategy3_known", "parse_variant_format", "protein_to_genomic", "annotate_variant_core",
    "csv_export_rows", "sort_cadd_desc", "semantic_topk", "liftover_37_to_38",
]
LLM = [
    "op1_exact_dedup", "op2_best_fit_packing", "op3_lm_scoring", "op4_url_filter", "op5_quality_classifier", "op6_bpe_encoding", "op7_quality_rules", "op8_html_extraction", "op9_toxicity", "op10_simhash_near_dedup",
    "op11_nearest_neighbours", "op12_conversation_trie", "op13_embedding_whitening",
]


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g"))
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from pyspark.sql import functions as F

    from genoplane import queries, service
    from genoplane.operators import filters as flt
    from genoplane.operators import variants as var
    from genoplane.plans.browse import by_gene
    from genoplane.sources import fixtures
    from genoplane.sources.catalog import Catalog

    queries.load()
    folder = Path(tempfile.mkdtemp(prefix="bench-"))
    tables = {}
    for name in fixtures.TABLES:
        # Each from the tables written before it, in as many files as there are cores.
        made = Catalog(spark, SF_DIR, tables)[name].repartition(int(CPUS))
        made.write.parquet(str(folder / name))
        tables[name] = str(folder / name)
    print("tables written", file=sys.stderr, flush=True)
    # As a load of a release writes it.
    stored = Catalog(spark, SF_DIR, tables).write_derived(str(folder / "loaded"))
    runs = {name: (lambda f=queries.FUNCTIONS[name]: f(stored)) for name in ENGINE}
    # The published pair: known variants of one gene, by the comma list and by the exploded lookup.
    one_gene = lambda: var.expand(by_gene(stored["mapping"], ["GENE7"]))
    runs["one_gene_known_delimited"] = lambda: flt.known_variants(one_gene(), stored["dbsnp"], F.split("alt", ",")).agg(F.count("*").alias("n"))
    runs["one_gene_known_lookup"] = lambda: flt.known_variants(one_gene(), stored["mapping_dbsnp_lookup"]).agg(F.count("*").alias("n"))
    # A user's request: a thousand lines, all 44 cells, in order.
    runs["download_thousand_lines"] = lambda: service.download_lines(stored["download_input"].limit(1000), stored)
    try:
        from genoplane.llm import queries as llm

        runs |= {name: (lambda f=llm.QUERIES[name]: f(spark, SF_DIR)) for name in LLM}
    except ImportError:
        pass
    took = {}
    for name, run in runs.items():
        for _ in range(2):
            began = time.perf_counter()
            run().write.format("noop").mode("overwrite").save()
            took[name] = round(time.perf_counter() - began, 3)
        print(name, took[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "total seconds of the headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": Path(SF_DIR).name}))
    spark.stop()


if __name__ == "__main__":
    main()
