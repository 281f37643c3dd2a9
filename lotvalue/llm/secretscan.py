"""Secrets in texts, told from copied examples by who holds them across the whole corpus.

Three kinds of pattern give the base spans of a text. Beside them every token that could be a credential is a candidate: 16 or more
letters, digits and ``+/_-`` in a row, with a letter and a digit and eight different characters or more. Candidates are
hashed, and counted over the corpus by distinct repositories and owners. What many owners hold is a widely copied
example; what at most ``OWNERS`` hold is looked on as live. Live candidates outside of base spans become spans of the kind
``owned`` if their value stands in a base span somewhere in the corpus, or if it looks random by itself (20 characters or more,
three each of small letters, capitals and digits, no separator).

Only DataFrame functions are used. The texts are read once; what is shuffled are hashes and places of candidates. Counts are
combined before each shuffle, and a value that a third of all texts hold meets its counts in a merge join, which adaptive
execution splits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import store

OWNERS = 2
KINDS = ("assign", "access", "hex", "owned")
#: Patterns of the base kinds. Only the key words of the first are read in either case.
ASSIGN = """(?i:password|passwd|secret|token|api_?key)["']?\\x20*[:=]\\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}"
TOKEN = "(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}"
RANDOM = ("[a-z].*[a-z].*[a-z]", "[A-Z].*[A-Z].*[A-Z]", "[0-9].*[0-9].*[0-9]", "^[A-Za-z0-9+]{20,}$")
_BLOCK = 256


def running(lengths: Column) -> Column:
    """The sum of what stands before each element of an array; in blocks, so that long arrays are not copied per element."""
    def sums(xs, first):
        step = lambda s, x: F.struct((s["at"] + x).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out"))
        return F.aggregate(xs, F.struct(first.alias("at"), F.array().cast("array<long>").alias("out")), step)

    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / _BLOCK).cast("int")),
                         lambda b: F.slice(lengths, b * _BLOCK + 1, _BLOCK))
    zero = F.lit(0).cast("long")
    first = sums(F.transform(blocks, lambda xs: F.aggregate(xs, zero, lambda s, x: s + x)), zero)["out"]
    return F.when(F.size(lengths) > 0, F.flatten(F.zip_with(blocks, first, lambda xs, at: sums(xs, at)["out"]))) \
        .otherwise(F.array().cast("array<long>"))


def with_matches(df: DataFrame, text: str, pattern: str, name: str) -> DataFrame:
    """Adds ``name``: array of (start, stop, value) of the leftmost matches that don't overlap, places in code points."""
    value, between, start = f"_{name}_value", f"_{name}_between", f"_{name}_start"
    lengths = F.zip_with(value, F.slice(between, F.lit(2), F.size(value)), lambda v, b: (F.length(v) + F.length(b)).cast("long"))
    place = F.zip_with(value, start, lambda v, at: F.struct((at + F.length(F.element_at(between, 1))).alias("start"),
                                                            (at + F.length(F.element_at(between, 1)) + F.length(v)).alias("stop"),
                                                            v.alias("value")))
    return (df.withColumn(value, F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
              .withColumn(between, F.when(F.size(value) > 0, F.split(text, pattern, -1)).otherwise(F.array(F.lit(""))))
              .withColumn(start, lengths).withColumn(start, running(F.col(start)))
              .withColumn(name, place).drop(value, between, start))


def _hash(value: Column) -> Column:
    return F.struct(F.xxhash64(value).alias("a"), F.xxhash64(F.lit("again"), value).alias("b"))


def candidates(docs: DataFrame, repository: Column | None = None, owner: Column | None = None) -> DataFrame:
    """Stored, one row per row of ``docs``: row, doc_id, repository, owner, base (start, kind, stop), tokens.

    tokens: start, stop, hash (two longs), inside (a base span), random.
    """
    source = F.col("source") if repository is None else repository
    held = F.regexp_replace(source, "/[^/]*$", "") if owner is None else owner
    df = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", source.cast("string").alias("repository"),
                     held.cast("string").alias("owner"), F.coalesce("text", F.lit("")).alias("text"))
    for name, pattern in (("assign", ASSIGN), ("access", ACCESS), ("hex", HEX), ("token", TOKEN)):
        df = with_matches(df, "text", pattern, name)
    df = df.withColumn("assign", F.filter("assign", lambda m: F.length(F.regexp_extract(m["value"], ASSIGN, 1)) >= 6))

    def of_kind(i):
        return F.transform(KINDS[i], lambda m: F.struct(m["start"].alias("start"), F.lit(i).alias("kind"), m["stop"].alias("stop")))

    base = F.array_sort(F.concat(of_kind(0), of_kind(1), of_kind(2)))
    likely = F.filter("token", lambda m: m["value"].rlike("[0-9]") & m["value"].rlike("[A-Za-z]")
                      & (F.size(F.array_distinct(F.split(m["value"], ""))) >= 8))
    df = df.withColumn("base", base).withColumn("token", likely)

    def random(value):
        out = value.rlike(RANDOM[0])
        for pattern in RANDOM[1:]:
            out = out & value.rlike(pattern)
        return out

    tokens = F.transform("token", lambda m: F.struct(
        m["start"].alias("start"), m["stop"].alias("stop"), _hash(m["value"]).alias("hash"),
        F.exists("base", lambda b: (b["start"] < m["stop"]) & (m["start"] < b["stop"])).alias("inside"),
        random(m["value"]).alias("random")))
    return store(df.select("row", "doc_id", "repository", "owner", "base", tokens.alias("tokens")), "secret_candidates")


def ownership(found: DataFrame, owners: int = OWNERS) -> DataFrame:
    """Of ``candidates``: hash, n_owners, n_repositories, n_documents, n_inside (occurrences in base spans), live."""
    each = found.select("repository", "owner", F.posexplode("tokens").alias("i", "t"), "tokens").select(
        "repository", "owner", "t.hash", F.col("t.inside").cast("long").alias("inside"),
        (F.array_position(F.transform("tokens", lambda t: t["hash"]), F.col("t.hash")) == F.col("i") + 1).cast("long").alias("new"))
    per_repository = each.groupBy("hash", "owner", "repository").agg(F.sum("inside").alias("n_inside"), F.sum("new").alias("n"))
    per_owner = per_repository.groupBy("hash", "owner").agg(
        F.count("*").alias("n_repositories"), F.sum("n_inside").alias("n_inside"), F.sum("n").alias("n"))
    return per_owner.groupBy("hash").agg(
        F.count("*").alias("n_owners"), F.sum("n_repositories").alias("n_repositories"), F.sum("n").alias("n_documents"),
        F.sum("n_inside").alias("n_inside")).withColumn("live", F.col("n_owners") <= owners)


def scan(docs: DataFrame, owners: int = OWNERS, repository: Column | None = None, owner: Column | None = None) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, source): doc_id, base and spans (arrays of start, kind, stop).

    repository: the source by default; owner: the source without what follows its last slash. Null ones are one of their own.
    base: the spans of the patterns, whole matches, places in code points, stop exclusive. spans: these and the owned ones, by
    start, then kind as ``KINDS`` numbers them. A null text is empty and has no spans. Repeated rows are rows of their own, and
    count as one repository; repeated and null doc_ids stay. An empty table gives an empty one; other columns are
    ignored. Texts of any length are read whole.
    """
    found = candidates(docs, repository, owner)
    known = ownership(found, owners).where("live").select("hash", "n_inside")
    outside = found.select("row", F.explode(F.filter("tokens", lambda t: ~t["inside"])).alias("t")).select("row", "t.*")
    owned = outside.join(known.hint("merge"), "hash").where("random or n_inside > 0").groupBy("row").agg(
        F.collect_list(F.struct("start", F.lit(3).alias("kind"), "stop")).alias("owned"))
    none = F.array().cast("array<struct<start:bigint,kind:int,stop:bigint>>")
    return found.select("row", "doc_id", "base").join(owned.hint("merge"), "row", "left").select(
        "doc_id", "base", F.array_sort(F.concat("base", F.coalesce("owned", none))).alias("spans"))


def listed(spans: str) -> Column:
    """kind:start:stop, joined by commas."""
    name = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(name, s["kind"]), s["start"], s["stop"])), ",")


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of the whole corpus ``docs``."""
    def count(i):
        return F.size(F.filter("base", lambda s: s["kind"] == i)).cast("long").alias(f"n_{KINDS[i]}")
    return scan(docs).select("doc_id", count(0), count(1), count(2),
                             F.sha2(listed("base"), 256).alias("base_sha256"), listed("spans").alias("spans"))


def _sql_matches(name: str, pattern: str) -> str:
    """SQL of ``name`` (row, start, stop, value): places from the lengths of matches and of what lies between them."""
    quoted = pattern.replace("'", "''")
    return f"""
    {name}_parts AS (SELECT row, regexp_extract_all(text, '{quoted}') AS v, string_split_regex(text, '{quoted}') AS b FROM d),
    {name}_rows AS (SELECT row, v, b, unnest(generate_series(1, len(v))) AS i FROM {name}_parts WHERE len(v) > 0),
    {name}_at AS (SELECT row, v[i] AS value, sum(length(b[i])) OVER w + coalesce(sum(length(v[i])) OVER (
        PARTITION BY row ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
        FROM {name}_rows WINDOW w AS (PARTITION BY row ORDER BY i)),
    {name} AS (SELECT row, start, start + length(value) AS stop, value FROM {name}_at)"""


# The other engine folds case beyond ASCII and has no look-behind: there the words are spelled out, and a leftmost match begins its token anyway.
_WORDS = ("password", "passwd", "secret", "token")
_SPELLED = "|".join("".join(f"[{c.upper()}{c}]" for c in word) for word in _WORDS) + "|[Aa][Pp][Ii]_?[Kk][Ee][Yy]"
_ASSIGN = f"(?:{_SPELLED}){ASSIGN[ASSIGN.index(')') + 1:]}"
_assign = _ASSIGN.replace("'", "''")
SQL = f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text, source AS repository,
        regexp_replace(source, '/[^/]*$', '') AS owner FROM documents),
    {_sql_matches('assign', _ASSIGN)}, {_sql_matches('access', ACCESS)}, {_sql_matches('hex', HEX)}, {_sql_matches('tokens', TOKEN[TOKEN.index(')') + 1:])},
    base AS (SELECT row, start, 0 AS kind, stop FROM assign WHERE length(regexp_extract(value, '{_assign}', 1)) >= 6
        UNION ALL SELECT row, start, 1, stop FROM access UNION ALL SELECT row, start, 2, stop FROM hex),
    likely AS (SELECT *, EXISTS (SELECT 1 FROM base AS b WHERE b.row = t.row AND b.start < t.stop AND t.start < b.stop) AS inside
        FROM tokens AS t WHERE regexp_matches(value, '[0-9]') AND regexp_matches(value, '[A-Za-z]')
            AND len(list_distinct(string_split(value, ''))) >= 8),
    held AS (SELECT value, count(DISTINCT coalesce('=' || owner, '')) AS n_owners, count(*) FILTER (inside) AS n_inside
        FROM likely JOIN d USING (row) GROUP BY 1),
    spans AS (SELECT row, start, kind, stop FROM base UNION ALL
        SELECT row, start, 3, stop FROM likely JOIN held USING (value) WHERE NOT inside AND n_owners <= {OWNERS}
            AND (n_inside > 0 OR ({' AND '.join(f"regexp_matches(value, '{p}')" for p in RANDOM)}))),
    named AS (SELECT *, (['assign', 'access', 'hex', 'owned'])[kind + 1] || ':' || start::bigint || ':' || stop::bigint AS s FROM spans),
    lists AS (SELECT row, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access,
        count(*) FILTER (kind = 2) AS n_hex, coalesce(string_agg(s, ',' ORDER BY start, kind) FILTER (kind < 3), '') AS base,
        string_agg(s, ',' ORDER BY start, kind) AS spans FROM named GROUP BY 1)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
    sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN lists USING (row)"""
