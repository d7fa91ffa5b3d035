"""Benchmark: headline plans on $BENCH_SF_DIR with local[$BENCH_CPUS].

Prints ONE JSON line:
{"metric": "total_sec", "value": N, "unit": "sec", "queries": {...}, "sf": ..., ...}

Headline plans (each timed end to end, result materialised with a count):
  kb_build        documents -> sections -> sentences -> tags -> KB tables
  answer          all user turns of conversations answered against the KB
  pages_to_docs   pages -> HTML rendering job -> cleaned docs
  tag_entities    sentence split + tagging + entity extraction (no KB ids)
  progress        completion-progress windows over events
Throughput figures (sentences/s, questions/s) are reported alongside.
"""

from __future__ import annotations

import json
import os
import re
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from kbspark.operators import retrieval as R  # noqa: E402
from kbspark.plans import build as B  # noqa: E402
from kbspark.plans import queries as Q  # noqa: E402
from kbspark.session import get_session  # noqa: E402


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    # a folder of this local run alone: nothing that an earlier one published is found
    spark = get_session(master=f"local[{cpus}]", shuffle_partitions=int(cpus) * 2, checkpoint_dir=tempfile.mkdtemp(prefix="kbspark-bench-"))
    times: dict[str, float] = {}
    extra: dict[str, float] = {}

    def timed(name, fn):
        t0 = time.time()
        out = fn()
        times[name] = round(time.time() - t0, 3)
        return out

    kb = timed("kb_build", lambda: B.kb_from_documents(spark, sf_dir))
    n_sent = kb.sentences.count()
    extra["kb_sentences"] = n_sent
    extra["kb_sentences_per_sec"] = round(n_sent / max(times["kb_build"], 1e-9), 1)

    ans = timed("answer", lambda: B.answers(spark, sf_dir).count() and B.answers(spark, sf_dir))
    n_q = B.user_questions(spark, sf_dir).count()
    extra["questions"] = n_q
    extra["questions_per_sec"] = round(n_q / max(times["answer"], 1e-9), 2)
    extra["answer_rows"] = ans.count()
    found = B.retrieval(spark, sf_dir)
    grams = found.lookups.select("gram").distinct()
    n_grams = max(grams.count(), 1)
    extra["grams"] = n_grams
    extra["top_candidates_per_gram"] = round(found.top.count() / n_grams, 3)
    extra["blocked_pairs_per_gram"] = round(R.blocked_pairs(grams, kb.entities).count() / n_grams, 1)

    timed("pages_to_docs", lambda: Q.c6_docs_from_pages(spark, sf_dir).count())
    timed("tag_entities", lambda: Q.e3_entities(spark, sf_dir).count())
    timed("progress", lambda: Q.k14_progress(spark, sf_dir).agg(F.sum("n")).collect())

    m = re.search(r"sf([0-9.]+)", sf_dir)
    out = {"metric": "total_sec", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
           "sf": float(m.group(1)) if m else sf_dir, "cpus": int(cpus), **extra}
    print(json.dumps(out))


if __name__ == "__main__":
    main()
