"""Small SQL text builders for the DuckDB oracles (unrolled folds)."""

from __future__ import annotations


def fefo_fold_sql(src: str, horizon: int) -> str:
    """Unrolled FEFO fold over ``horizon`` days.

    ``src`` must have columns item_id, b0..b{h} (bucket quantities) and
    d0..d{h-1} (integer demands).  Returns a SELECT producing item_id,
    expected_waste_qty, expected_sales_fulfilled_qty, expected_lost_sales_qty.
    """
    h = horizon
    cum = [" + ".join(f"b{i}" for i in range(k + 1)) for k in range(h + 1)]
    parts = [f"s0 AS (SELECT item_id, {', '.join(f'({c}) AS c{k}' for k, c in enumerate(cum))}, "
             f"{', '.join(f'd{j}' for j in range(h))}, "
             f"CAST(0 AS BIGINT) AS p, CAST(0 AS BIGINT) AS w, CAST(0 AS BIGINT) AS f, CAST(0 AS BIGINT) AS l FROM {src})"]
    keep = f"item_id, {', '.join(f'c{k}' for k in range(h + 1))}, {', '.join(f'd{j}' for j in range(h))}"
    for j in range(h):
        p1 = f"greatest(p, c{j})"
        take = f"least(d{j}, c{h} - {p1})"
        parts.append(
            f"s{j + 1} AS (SELECT {keep}, {p1} + {take} AS p, w + {p1} - p AS w, f + {take} AS f, "
            f"l + d{j} - {take} AS l FROM s{j})")
    return ",\n".join(parts), f"s{h}"
