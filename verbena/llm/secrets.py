"""Secret scans with multipart credential linking (native).

Base spans are what three patterns match: assigned secrets, access identifiers and long hex values.
Beside them stand weak candidates, which say little alone: named accounts (``account``), endpoints
(``endpoint``) and mixed strings (``mixed``). Parts of a credential are identifiers (access,
account), secrets (assign, hex, mixed) and endpoints. An interval join finds parts that lie within
``SCOPE`` characters of each other in one text; a weak identifier or endpoint is reported if a
secret is in its scope, a weak secret if an identifier or an endpoint is.

The parts of a text are joined by the text's digest and by bins of ``SCOPE`` characters, so a long
text is spread over many keys and a bin holds a bounded number of parts; copies of a text are
joined once. Places count code points from 0; ends are exclusive.

Defined cases. A null text is the empty text and has no spans. The spans of a row depend on its
text alone, so null or repeated ids and repeated rows need no care. An empty table gives no rows.
Parts that overlap do not complement each other; ties in start go by kind, then by end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verbena.llm.support import let, text_of
from verbena.session import written

SCOPE = 200

# Patterns of both Java and RE2; (?i) is spelled out, as engines differ in what it folds.
LETTERS = {
    "password": "[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]",
    "passwd": "[Pp][Aa][Ss][Ss][Ww][Dd]",
    "secret": "[Ss][Ee][Cc][Rr][Ee][Tt]",
    "token": "[Tt][Oo][Kk][Ee][Nn]",
    "api_key": "[Aa][Pp][Ii]_?[Kk][Ee][Yy]",
}
SET = r"""["']?\x20*[:=]\x20*["']?"""
ASSIGN = rf"({'|'.join(LETTERS.values())}){SET}([A-Za-z0-9+/_.=-]+)"
PATTERNS = {
    "assign": ASSIGN,
    "access": r"AKIA[A-Z0-9]{16,}",
    "hex": r"[0-9a-f]{24,}",
    "account": rf"([Uu]ser(name|_id)?|[Ll]ogin|[Aa]ccount(_id)?|[Cc]lient_id){SET}([A-Za-z0-9_.@-]+)",
    "endpoint": r"(https?|jdbc:[a-z]+|postgres|mysql|mongodb|redis|amqp|s3)://[A-Za-z0-9._:/@-]+",
    "mixed": r"[A-Za-z0-9+/_-]{24,}",
}
KINDS = list(PATTERNS)  # in the order that breaks ties
BASE = ["assign", "access", "hex"]
ROLE = {
    "assign": "secret",
    "access": "identifier",
    "hex": "secret",
    "account": "identifier",
    "endpoint": "endpoint",
    "mixed": "secret",
}
SPAN = "array<struct<kind:int,start:int,end:int>>"


def spans(text: Column, kind: str) -> Column:
    """Leftmost matches that do not overlap, as kind, start and end.

    The text between matches and the matches themselves, laid end to end, give the places.
    """
    pattern = PATTERNS[kind]
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.transform(F.split(text, pattern, -1), lambda x: F.length(x))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(2)) if kind == "assign" else found
    good = {
        "assign": lambda v: F.length(v) >= 6,
        "mixed": lambda v: v.rlike("[0-9]") & v.rlike("[a-z]") & v.rlike("[A-Z]"),
    }.get(kind, lambda v: F.lit(True))

    def placed(s: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out"))

        def step(a: Column, i: Column) -> Column:
            begin = a["at"] + F.get(s["between"], i)
            end = begin + F.length(F.get(s["found"], i))
            span = F.struct(
                F.lit(KINDS.index(kind)).alias("kind"), begin.alias("start"), end.alias("end")
            )
            kept = F.when(good(F.get(s["value"], i)), F.array(span)).otherwise(
                F.array().cast(SPAN)
            )
            return F.struct(end.alias("at"), F.concat(a["out"], kept).alias("out"))

        places = F.sequence(F.lit(0), F.size(s["found"]) - 1)
        return F.aggregate(places, start, step, lambda a: a["out"])

    parts = F.struct(found.alias("found"), between.alias("between"), value.alias("value"))
    some = let(parts, placed)
    likely = F.contains(text, F.lit("AKIA")) if kind == "access" else text.rlike(pattern)
    likely = F.contains(text, F.lit("://")) & likely if kind == "endpoint" else likely
    return F.when(likely, some).otherwise(F.array().cast(SPAN))


def apart(spans: Column, others: Column) -> Column:
    """The spans that overlap none of the others."""
    return F.filter(
        spans,
        lambda a: ~F.exists(others, lambda b: (a["start"] < b["end"]) & (b["start"] < a["end"])),
    )


def linked_parts(parts: DataFrame, scope: int = SCOPE) -> DataFrame:
    """Parts that a complementary one lies near: ``text_key, kind, start, end``.

    ``parts``: text_key, kind (number), role, start, end. A part is met by what begins within
    ``scope`` after its end; both of a pair that complements are linked.
    """
    bins = F.floor(F.col("end") / scope)
    left = parts.select(
        "text_key",
        F.explode(F.array(bins, bins + 1)).alias("bin"),
        F.struct("kind", "role", "start", "end").alias("a"),
    )
    right = parts.select(
        "text_key",
        F.floor(F.col("start") / scope).alias("bin"),
        F.struct("kind", "role", "start", "end").alias("b"),
    )
    gap = F.col("b.start") - F.col("a.end")
    roles = F.col("a.role"), F.col("b.role")
    # Exactly one of the two is a secret.
    fits = (roles[0] == "secret") != (roles[1] == "secret")
    pairs = left.join(right, ["text_key", "bin"]).filter(fits & gap.between(0, scope))
    both = pairs.select("text_key", F.explode(F.array("a", "b")).alias("p"))
    return both.select("text_key", "p.kind", "p.start", "p.end").distinct()


def find_secrets(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``doc_id, base, spans``: base spans and all reported spans, in order, kinds by number."""
    value = F.col("value")
    base = docs.select(F.col(key).alias("doc_id"), text_of(text).alias("value")).select(
        "doc_id", "value", *[spans(value, k).alias(k) for k in BASE]
    )
    strong = base.withColumn("strong", F.concat(*BASE)).drop(*BASE)
    mixed = strong.withColumn("mixed", apart(spans(value, "mixed"), F.col("strong")))
    # Without a secret nothing is linked; only texts with one are searched for the other parts.
    secret = (F.size("mixed") > 0) | F.exists(
        "strong", lambda s: s["kind"] != KINDS.index("access")
    )
    rest = [
        F.when(secret, apart(spans(value, k), F.col("strong")))
        .otherwise(F.array().cast(SPAN))
        .alias(k)
        for k in ("account", "endpoint")
    ]
    found = mixed.select("doc_id", "value", "strong", "mixed", *rest).select(
        "doc_id",
        F.array_sort("strong").alias("strong"),
        F.concat("mixed", "account", "endpoint").alias("weak"),
        F.when(F.size(F.concat("mixed", "account", "endpoint")) > 0, F.md5("value")).alias(
            "text_key"
        ),
    )
    found = written(found, "parts")
    unsure = found.filter("text_key IS NOT NULL")
    role = F.create_map(*[F.lit(x) for i, k in enumerate(KINDS) for x in (i, ROLE[k])])
    parts = (
        unsure.dropDuplicates(["text_key"])
        .select("text_key", F.explode(F.concat("strong", "weak")).alias("p"))
        .select("text_key", "p.kind", F.element_at(role, F.col("p.kind")).alias("role"), "p.start", "p.end")
    )
    weak = linked_parts(parts).filter(F.col("kind") >= len(BASE))
    by_text = weak.groupBy("text_key").agg(
        F.collect_list(F.struct("kind", "start", "end")).alias("linked")
    )
    joined = unsure.join(by_text, "text_key", "left").select(
        "doc_id", "strong", F.coalesce("linked", F.array().cast(SPAN)).alias("linked")
    )
    sure = found.filter("text_key IS NULL").select(
        "doc_id", "strong", F.array().cast(SPAN).alias("linked")
    )
    return sure.unionByName(joined).select(
        "doc_id",
        in_order(F.col("strong")).alias("base"),
        in_order(F.concat("strong", "linked")).alias("spans"),
    )


def in_order(spans: Column) -> Column:
    """Spans by start, then kind, then end."""
    keyed = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    return F.array_sort(keyed)


def written_out(spans: Column) -> Column:
    """``kind:start:end`` of each span, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])),
        ",",
    )


def digest(found: DataFrame) -> DataFrame:
    """Counts and digests of :func:`find_secrets`."""

    def count(kind: str) -> Column:
        number = KINDS.index(kind)
        return F.size(F.filter("base", lambda s: s["kind"] == number)).cast("long")

    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in BASE],
        F.sha2(written_out(F.col("base")), 256).alias("base_sha256"),
        written_out(F.col("spans")).alias("spans"),
    )


def _matches(kind: str) -> str:
    """SQL: rows (rid, kind, start, end) of a pattern's good matches in d(rid, text)."""
    pattern = PATTERNS[kind].replace("'", "''")
    good = {
        "assign": f"length(regexp_extract(m, '{pattern}', 2)) >= 6",
        "mixed": "regexp_matches(m, '[0-9]') AND regexp_matches(m, '[a-z]') AND regexp_matches(m, '[A-Z]')",
    }.get(kind, "true")
    return f"""
  SELECT rid, {KINDS.index(kind)} AS kind, '{ROLE[kind]}' AS role,
    (before + length_before)::BIGINT AS s, (before + length_before + length(m))::BIGINT AS e
  FROM (
    SELECT rid, i, m, between_length, 
      sum(between_length) OVER (PARTITION BY rid ORDER BY i) AS before,
      coalesce(sum(length(m)) OVER (PARTITION BY rid ORDER BY i
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS length_before
    FROM (
      SELECT rid, unnest(found) AS m, generate_subscripts(found, 1) AS i,
        unnest(list_transform(gaps[1:len(found)], lambda x: length(x))) AS between_length
      FROM (
        SELECT rid, regexp_extract_all(text, '{pattern}') AS found,
          string_split_regex(text, '{pattern}') AS gaps
        FROM d) WHERE len(found) > 0))
  WHERE {good}"""


SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
strong AS ({" UNION ALL ".join(_matches(k) for k in BASE)}),
maybe AS ({" UNION ALL ".join(_matches(k) for k in KINDS if k not in BASE)}),
weak AS (
  SELECT * FROM maybe m WHERE NOT EXISTS (
    SELECT 1 FROM strong s WHERE s.rid = m.rid AND m.s < s.e AND s.s < m.e)),
parts AS (SELECT * FROM strong UNION ALL SELECT * FROM weak),
linked AS (
  SELECT DISTINCT w.rid, w.kind, w.role, w.s, w.e
  FROM weak w JOIN parts p ON w.rid = p.rid
    AND (w.role = 'secret') <> (p.role = 'secret')
    AND (p.s - w.e BETWEEN 0 AND {SCOPE} OR w.s - p.e BETWEEN 0 AND {SCOPE})),
named AS (
  SELECT rid, kind, s, e, kind < {len(BASE)} AS base,
    list_value({", ".join(f"'{k}'" for k in KINDS)})[kind + 1] || ':' || s || ':' || e AS t
  FROM (SELECT * FROM strong UNION ALL SELECT * FROM linked)),
joined AS (
  SELECT rid, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access,
    count(*) FILTER (kind = 2) AS n_hex,
    string_agg(t, ',' ORDER BY s, kind, e) FILTER (base) AS base,
    string_agg(t, ',' ORDER BY s, kind, e) AS spans
  FROM named GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access,
  coalesce(n_hex, 0)::BIGINT AS n_hex, sha256(coalesce(base, '')) AS base_sha256,
  coalesce(spans, '') AS spans
FROM d LEFT JOIN joined ON d.rid = joined.rid"""
