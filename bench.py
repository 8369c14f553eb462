"""Times the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose the
data and the cores.  Each query writes to the noop sink once to warm up and is
then timed; the value is the sum over queries.
"""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "sliding_features", "trailing_ratio", "tumbling_mean", "pair_decimate", "range_jump_filter", "gap_interpolate",
    "rolling_median5", "median_filter11", "spike_mask", "box_rolling_dc", "baseline_wander", "signal_quantiles", "znorm",
    "time_parse", "motion_flag", "motion_intervals", "resample_linear", "lag_xcorr", "time_sync_join", "dim_lookup",
    "anti_train", "ratio_of_ratios", "welch_sqi", "relative_power", "bandpass_order5", "causal_lowpass", "lms_anc",
    "polyphase", "weighted_ols", "quadratic_fit", "cv_metrics", "transfer_apply", "error_hist", "purged_split", "block_shuffle",
)


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from pulsegrid.plans import catalog
    from pulsegrid.session import build_session

    spark = build_session(
        "bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false", spark__driver__memory="12g",
    )
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name in HEADLINE:
        for _ in range(2):
            start = time.perf_counter()
            catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": float(sf)}))


if __name__ == "__main__":
    main()
