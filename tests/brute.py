"""Serving features by a plain loop over sorted events."""

import collections
import math

import numpy as np

MINUTE = 60_000_000


def brute_features(events):
    """events of one key: (us, status, latency, hash) in order. Returns {now_us: features} per minute tick."""
    ticks, history = {}, []
    last_of = {}
    for i, e in enumerate(events):
        last_of[e[0] // MINUTE] = i
    for i in last_of.values():
        now = events[i][0]
        a, b, c = ([x for x in events[: i + 1] if x[0] >= now - w * MINUTE] for w in (1, 5, 15))
        lat = [x[2] for x in a]
        f = {f"p{q}_latency": float(np.percentile(lat, q)) for q in (50, 90, 95)}
        share = lambda rows: sum(x[1] >= 500 for x in rows) / len(rows)
        changes = [(p, q) for p, q in zip(c, c[1:]) if p[3] and q[3] and p[3] != q[3]]
        seen = collections.Counter(x[3] for x in c if x[3])
        total = sum(seen.values())
        f |= {
            "latency_variance": float(np.var(lat)),
            "latency_delta": f["p50_latency"] - np.mean([x[2] for x in b]),
            "error_rate": share(a),
            "error_rate_delta": share(a) - share(b),
            "traffic_rps": len(a) / 60,
            "traffic_delta": len(a) / 60 - len(b) / 300,
            "schema_fields_added": float(len(changes)),
            "schema_fields_removed": float(max(0, len(changes) - 1)),
            "schema_breaking_changes": float(any(q[1] >= 500 for _, q in changes)),
            "recent_deploy": float(bool(changes)),
            "schema_entropy": -sum(v / total * math.log2(v / total) for v in seen.values()) if total else 0.0,
            "p95_to_p50_ratio": f["p95_latency"] / max(f["p50_latency"], 1),
            "is_warmed_up": i + 1 >= 100,
        }
        h = history[-180:]
        col = lambda name: [x[name] for x in h]
        p95, err, z = col("p95_latency"), col("error_rate"), col("p95_latency")[-30:]
        ewm = err[0] if err else 0.0
        for x in err[1:]:
            ewm = 0.3 * x + 0.7 * ewm
        f |= {
            "schema_entropy_delta": f["schema_entropy"] - h[-1]["schema_entropy"] if h else 0.0,
            "p95_latency_roll_mean_15": np.mean(p95[-15:]) if h else f["p95_latency"],
            "latency_variance_roll_std_15": np.std(col("latency_variance")[-15:]) if len(h) > 1 else 0.0,
            "error_rate_roll_mean_15": np.mean(err[-15:]) if h else f["error_rate"],
            "error_rate_acceleration": (err[-1] - err[-2]) - (err[-2] - err[-3]) if len(h) >= 3 else 0.0,
            "traffic_utilization_proxy": (np.mean(col("traffic_rps")[-10:]) if h else f["traffic_rps"]) / 2000,
            "latency_p95_zscore": (z[-1] - np.mean(z)) / np.std(z) if len(z) > 1 and max(z) > min(z) else 0.0,
            "error_rate_ewm": ewm,
            "p95_latency_roll_max_15": max(p95[-15:]) if h else f["p95_latency"],
            "error_high_streak": float(sum(x > np.quantile(err, 0.8) for x in err[-10:])) if len(h) >= 3 else 0.0,
        }
        history.append(f)
        ticks[now] = f
    return ticks
