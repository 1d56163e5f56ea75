"""Time the headline queries. Prints one JSON line.

Every query is timed to the end of a write to the noop sink. Stages shared by queries are built once, by
``corpus_stages``, and reported there; ``full_job`` is the whole job from the page table to written outputs.
"""

from __future__ import annotations

import json
import os
import tempfile
import time

from pageloom.plans import inputs, queries
from pageloom.plans.corpus import Corpus
from pageloom.session import local_session

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
RUNS = int(os.environ.get("BENCH_RUNS", "2"))
HEADLINE = (
    "article_paths", "page_tokens", "link_attributes", "page_nodes", "page_roundtrip", "article_text_hash", "site_rollup",
    "picture_choice", "placeholder_images", "embed_outcomes", "article_html", "clean_attributes", "media_table",
    "book_manifest", "book_navigation", "package_metadata", "log_progress", "log_size_peaks", "format_fallback",
    "oversize_breaches",
)


def timed(action) -> float:
    start = time.perf_counter()
    action()
    return round(time.perf_counter() - start, 3)


def drain(rows) -> None:
    rows.write.format("noop").mode("overwrite").save()


def full_job(spark) -> None:
    corpus = Corpus(
        spark,
        inputs.derive(spark, SF_DIR, inputs.PAGES_RICH),
        inputs.RUN_TS,
        requests=inputs.derive(spark, SF_DIR, inputs.REQUESTS),
        formats=inputs.derive(spark, SF_DIR, inputs.FORMATS_SPARK),
    )
    corpus.write(tempfile.mkdtemp(prefix="pageloom-bench-"), by_site=True)
    corpus.release()


def main() -> None:
    spark = local_session(CPUS, shuffle_partitions=int(CPUS))
    n_pages = inputs.table(spark, SF_DIR, "pages").count()
    job = [timed(lambda: full_job(spark)) for _ in range(RUNS)]
    results = {"full_job": min(job)}

    def stages() -> None:
        queries.release_all()
        for name in ("articles", "media"):
            getattr(queries._corpus(spark, SF_DIR, "rich"), name)
        getattr(queries._corpus(spark, SF_DIR, "plain"), "content")

    results["corpus_stages"] = timed(stages)
    for name in HEADLINE:
        results[name] = min(timed(lambda: drain(queries.QUERIES[name](spark, SF_DIR))) for _ in range(RUNS))
    print(
        json.dumps(
            {
                "metric": "total seconds of the headline queries and the full job",
                "value": round(sum(results.values()), 3),
                "unit": "sec",
                "queries": results,
                "sf": os.path.basename(SF_DIR.rstrip("/")),
                "pages": n_pages,
                "pages_per_second": round(n_pages / results["full_job"], 1),
                "cold_full_job": job[0],
            }
        )
    )


if __name__ == "__main__":
    main()
