"""Time the headline queries and print one JSON line.

Each query runs twice: ``queries`` holds the faster run, ``first`` the first one, with
class loading and just-in-time compilation. Queries that store what they build (streams,
snapshots, the folded ledger) run once: a second run would find it there. Building the
tables that several queries read is timed as it happens, under ``build_*``. All is written
to a folder of the run's own, which goes with it.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time
from functools import partial

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "search_page a_progress a_status s_holders_page f_holder a_totals j_by_name p_utxo j_subassets "
    "p_settings p_personalization p_reference s_name_asc j_by_address sink_name_list p_script "
    "a_holder_rollup p_asset_view j_list_search j_availability j_reconcile st_owner_upsert st_change_log "
    "a_manual_default st_canonical_chain st_rewind w_accept_gate etl_scanned_event k_datum_attrs "
    "enrich_content s_keyset f_search_postings s_random_page j_by_holder"
).split()
#: Run once: their time is mostly that of what they write.
ONCE = (
    "st_block_fold src_block_stream st_block_stream sink_foreach_batch st_resume_stream st_stateful_stream snap_restore snap_history"
).split()


def main() -> None:
    with tempfile.TemporaryDirectory(prefix="rollbook-bench-") as scratch:
        bench(scratch)


def bench(scratch: str) -> None:
    from rollbook.plans import QUERIES, ledger_queries
    from rollbook.session import build_session, read_table
    from rollbook.sources import fixtures

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("rollbook-bench", cores=cores, partitions=int(cores) if cores.isdigit() else 8, scratch=scratch)
    spark.sparkContext.setLogLevel("ERROR")
    wanted = os.environ.get("BENCH_QUERIES", "").split() or [*HEADLINE, *ONCE]
    read_table(spark, sf_dir, "orders").groupBy("o_orderstatus").count().collect()  # start-up
    seconds, first = {}, {}
    # the tables the queries read are built once; that is part of the timing
    for name, build in (
        ("registry", fixtures.registry),
        ("blocks", fixtures.blocks),
        ("folded", ledger_queries.folded_ledger),
        ("postings", fixtures.search_index),
        *((f"by_{key}", partial(fixtures.registry_by, key=key)) for key in fixtures.LOOKUP_KEYS),
    ):
        start = time.perf_counter()
        build(spark, sf_dir)
        seconds[f"build_{name}"] = round(time.perf_counter() - start, 3)
    for name in wanted:
        runs = []
        for _ in range(1 if name in ONCE else 2):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        seconds[name], first[name] = round(min(runs), 3), round(runs[0], 3)
    total = round(sum(seconds.values()), 3)
    sf = os.path.basename(sf_dir.rstrip("/"))
    print(json.dumps({"metric": "total_query_seconds", "value": total, "unit": "sec", "queries": seconds, "first": first, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
