"""One output shape per query, applied on both sides: names, types and rounding."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

# i: whole number, s: text, d: date as text, fN: number rounded to N places. Rounding is spelled out as plain double
# arithmetic, so that both engines do the same operations and none goes through decimals row by row.


def parse(spec: str) -> list[tuple[str, str]]:
    return [tuple(part.strip().split(":")) for part in spec.split(",")]


def shaped(df: DataFrame, spec: str) -> DataFrame:
    def one(name: str, kind: str):
        c = F.col(name)
        if kind == "i":
            c = c.cast("bigint")
        elif kind == "d":
            c = c.cast("date").cast("string")
        elif kind == "s":
            c = c.cast("string")
        else:
            scale = F.lit(10.0 ** int(kind[1:]))
            c = F.floor(c.cast("double") * scale + 0.5) / scale
        return c.alias(name)

    return df.select(*[one(n, k) for n, k in parse(spec)])


def shaped_sql(query: str, spec: str) -> str:
    def one(name: str, kind: str) -> str:
        if kind == "i":
            return f"cast({name} AS bigint) AS {name}"
        if kind == "d":
            return f"cast(cast({name} AS date) AS varchar) AS {name}"
        if kind == "s":
            return f"cast({name} AS varchar) AS {name}"
        scale = f"{10 ** int(kind[1:])}::double"
        return f"floor(cast({name} AS double) * {scale} + 0.5::double) / {scale} AS {name}"

    return f"SELECT {', '.join(one(n, k) for n, k in parse(spec))} FROM ({query}) AS shaped"
