"""Time the headline queries; prints one JSON line."""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from factloom.plans import registry  # noqa: E402
from factloom.plans.facts import forget_derived  # noqa: E402
from factloom.session import build_session  # noqa: E402

HEADLINE = (
    "k1_redact", "k3_secret_audit", "a4_incremental_diff", "g1_workspace_symbol_search", "c1_resolve_type_name",
    "d1_instance_ancestors", "c7_method_lookup", "c10_resolve_references", "i2_unknown_method", "s1_call_return_pairing",
    "e1_observed_signatures", "d10_invalidate_dependents",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench", f"local[{cpus}]", **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g"}
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = registry.queries()
    wanted = [q for q in sys.argv[1:] if q in queries] or HEADLINE
    spark.range(1).count()
    times = {}
    for name in wanted:
        # Every query pays for the shared tables it needs.
        forget_derived()
        start = time.time()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(sf_dir.rstrip("/")),
    }))


if __name__ == "__main__":
    main()
