r"""Secret scans with multipart credential linking.

Parts of credentials are spans of a text, in one of three roles:

* identifier: `access` (AKIA...), and weak `login` (user, client or account id given by name)
* secret: `assign` (password = ...), `hex` (24 or more hex digits), and weak `opaque` (a long mixed token)
* endpoint: weak `host` (a URL with a scheme, or an IPv4 address)

assign, access and hex are reported by themselves. A weak part is reported only
if a complementary part co-occurs: an identifier or endpoint needs a secret, a
secret needs an identifier or endpoint, within `gap` code points and in the
same scope (a stretch of text without an empty line). The interval join is a
sweep inside each row over its sorted spans, not a comparison of pairs: texts
need no shuffle, and rows with equal or null ids cannot mix. `opaque` and `login` spans that overlap a base span
are not reported again.

Matches are found with positions by extracting, from the end of one match to
the next (\G), the text between and the match. Edge cases: a null text is empty
and yields no spans; equal texts get equal spans; an empty table gives no rows;
other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideledger.llm.common import read_table

GAP = 160

#: kind: (pattern, group of the value, least length of the value), in the order of ties.
ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"
LOGIN = r"""(?i:user_?name|user_?id|user|login|client_?id|account_?id|account|access_?key_?id)["']?\x20*[:=]\x20*["']?([A-Za-z0-9_.@-]+)"""
OPAQUE = r"[A-Za-z0-9+/_=-]{24,}"
HOST = r"(?:(?:https?|ftps?|sftp|ssh|postgres|postgresql|mysql|redis|mongodb|amqp|s3)://[A-Za-z0-9._~:/?#@!$&*+,;=%-]+|[0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3})"
BREAK = r"\n[\x20\x09\x0D]*\n"

FAR = 1 << 30  # beyond any place in a text
BLOCK = 256  # items folded at a time
SPAN = "struct<start:int,kind:int,end:int>"
SPANS = f"array<{SPAN}>"
KINDS = ("assign", "access", "hex", "login", "opaque", "host")
BASE_KINDS = (0, 1, 2)
BREAK_KIND = len(KINDS)
ROLES = ("secret", "identifier", "secret", "identifier", "secret", "endpoint")


def spans_of(text: Column, pattern: str, kind: int, value_group: int = 0, least: int = 0, mixed: bool = False) -> Column:
    """The leftmost non-overlapping matches whose value has at least `least` characters, as (start, end, kind).

    mixed: only values with a digit and both an upper-case and a lower-case letter.
    """
    walk = F.lit(rf"\G((?s:.*?))({pattern})")
    gaps, matches = F.regexp_extract_all(text, walk, F.lit(1)), F.regexp_extract_all(text, walk, F.lit(2))
    values = F.regexp_extract_all(text, walk, F.lit(value_group + 2)) if value_group else matches
    rows = F.transform(F.arrays_zip(gaps, matches, values), lambda x: F.struct(F.length(x["0"]).alias("gap"), F.length(x["1"]).alias("size"), F.length(x["2"]).alias("value"), _mixed(x["2"]).alias("fits") if mixed else F.lit(True).alias("fits")))

    def found(at: Column, x: Column) -> Column:
        start = at + x["gap"]
        span = F.struct(start.alias("start"), F.lit(kind).alias("kind"), (start + x["size"]).alias("end"))
        return F.when((x["value"] >= least) & x["fits"], span)

    spans = _swept(rows, F.lit(0), lambda at, x: at + x["gap"] + x["size"], found, SPAN)
    return F.when(text.rlike(pattern), F.filter(spans, lambda s: s.isNotNull())).otherwise(F.array().cast(SPANS))


def _mixed(value: Column) -> Column:
    return value.rlike("[0-9]") & value.rlike("[a-z]") & value.rlike("[A-Z]")


def _let(value: Column, body) -> Column:
    """`body` of a value that is worked out once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def _swept(events: Column, state: Column, move, result, kind: str = "boolean") -> Column:
    """`result` of each event, given the state that the events before it left.

    Results gather in blocks and blocks in a list, so that no long array is
    copied for every event.
    """
    none, nothing = F.array().cast(f"array<{kind}>"), F.array().cast(f"array<array<{kind}>>")

    def step(a: Column, x: Column) -> Column:
        return F.struct(move(a["s"], x).alias("s"), F.concat(a["r"], F.array(result(a["s"], x))).alias("r"))

    def part(a: Column, block: Column) -> Column:
        folded = F.aggregate(block, F.struct(a["s"].alias("s"), none.alias("r")), step)
        return _let(folded, lambda f: F.struct(f["s"].alias("s"), F.concat(a["r"], F.array(f["r"])).alias("r")))

    def cut(e: Column) -> Column:
        return F.when(F.size(e) > 0, F.transform(F.sequence(F.lit(1), F.size(e), F.lit(BLOCK)), lambda i: F.slice(e, i, BLOCK))).otherwise(F.array())

    return F.aggregate(_let(events, cut), F.struct(state.alias("s"), nothing.alias("r")), part, lambda a: F.flatten(a["r"]))


def _zipped(events: Column, first: Column, second: Column) -> Column:
    """The arrays side by side, as fields 0, 1 and 2."""
    pairs = F.zip_with(events, first, lambda x, f: F.struct(x.alias("0"), f.alias("1")))
    return F.zip_with(pairs, second, lambda p, s: F.struct(p["0"].alias("0"), p["1"].alias("1"), s.alias("2")))


def _apart(spans: Column, base: Column) -> Column:
    """Spans that overlap no base span, by one sweep each way over both in order."""
    own = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), F.lit(False).alias("base")))
    other = F.transform(base, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), F.lit(True).alias("base")))

    def outside(events: Column) -> Column:
        hit = _swept(events, F.lit(-1), lambda s, x: F.when(x["base"], F.greatest(s, x["end"])).otherwise(s), lambda s, x: s > x["start"])
        back = _swept(F.reverse(events), F.lit(FAR), lambda s, x: F.when(x["base"], x["start"]).otherwise(s), lambda s, x: s < x["end"])
        return F.filter(_zipped(events, hit, F.reverse(back)), lambda m: ~m["0"]["base"] & ~m["1"] & ~m["2"])

    free = _let(F.array_sort(F.concat(own, other)), outside)
    return F.when((F.size(spans) > 0) & (F.size(base) > 0), F.transform(free, lambda m: F.struct(m["0"]["start"].alias("start"), m["0"]["kind"].alias("kind"), m["0"]["end"].alias("end")))).otherwise(spans)


def _role(kind: Column, role: str) -> Column:
    return kind.isin(*[k for k, r in enumerate(ROLES) if r == role])


def linked(parts: Column, breaks: Column, gap: int = GAP) -> Column:
    """The parts but for weak ones without a complementary part near them and in their scope, in order.

    A part's nearest complement decides: the one before it that reaches
    furthest, or the next to begin after it. One sweep each way over parts and
    breaks, which never overlap, carries both; a break forgets them.
    """
    secret = lambda x: _role(x["kind"], "secret")
    is_break = lambda x: x["kind"] == BREAK_KIND

    def sides(none: int, join):
        state = F.struct(F.lit(none).alias("secret"), F.lit(none).alias("other"))

        def move(s: Column, x: Column) -> Column:
            seen = F.struct(F.when(secret(x), join(s["secret"], x)).otherwise(s["secret"]).alias("secret"), F.when(secret(x), s["other"]).otherwise(join(s["other"], x)).alias("other"))
            return F.when(is_break(x), state).otherwise(seen)

        return state, move

    complement = lambda s, x: F.when(secret(x), s["other"]).otherwise(s["secret"])

    def near(events: Column) -> Column:
        forward = _swept(events, *sides(-FAR, lambda a, x: F.greatest(a, x["end"])), lambda s, x: x["start"] - complement(s, x) <= gap)
        back = _swept(F.reverse(events), *sides(FAR, lambda a, x: x["start"]), lambda s, x: complement(s, x) - x["end"] <= gap)
        return F.filter(_zipped(events, forward, F.reverse(back)), lambda m: ~is_break(m["0"]) & (m["0"]["kind"].isin(*BASE_KINDS) | m["1"] | m["2"]))

    return F.transform(_let(F.array_sort(F.concat(parts, breaks)), near), lambda m: m["0"])


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _count(spans: Column, kind: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def scan(docs: DataFrame, text: str = "text", gap: int = GAP) -> DataFrame:
    """Add base (assign, access and hex) and spans (base and linked weak parts), each sorted by start, then kind."""
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    plain = F.array_sort(F.concat(spans_of(t, ASSIGN, 0, 2, 6), spans_of(t, ACCESS, 1, 0, 20), spans_of(t, HEX, 2)))
    based = docs.drop("base", "spans", "_weak", "_breaks").withColumn("base", plain)
    base = F.col("base")
    weak = F.concat(_apart(F.concat(spans_of(t, LOGIN, 3, 1, 3), spans_of(t, OPAQUE, 4, mixed=True)), base), spans_of(t, HOST, 5))
    found = based.withColumn("_weak", weak).withColumn("_breaks", F.when(F.size("_weak") > 0, spans_of(t, BREAK, BREAK_KIND)).otherwise(F.array().cast(SPANS)))
    kept = F.when(F.size("_weak") > 0, linked(F.concat(base, F.col("_weak")), F.col("_breaks"), gap)).otherwise(base)
    return found.withColumn("spans", kept).drop("_weak", "_breaks")


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", *[_count(F.col("base"), k).alias(f"n_{KINDS[k]}") for k in range(3)], F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))


def _spans_sql(kind: int, pattern: str, value_group: int = 0, least: int = 0) -> str:
    quoted = f"(?s:(.*?))({pattern})".replace("'", "''")
    value = f"regexp_extract_all(text, '{quoted}', {value_group + 2})" if value_group else f"regexp_extract_all(text, '{quoted}', 2)"
    return f"""
    SELECT doc_id, {kind} AS kind, e - len(m) AS s, e, v FROM (
      SELECT doc_id, m, v, sum(len(g) + len(m)) OVER (PARTITION BY doc_id ORDER BY i) AS e FROM (
        SELECT doc_id, unnest(regexp_extract_all(text, '{quoted}', 1)) AS g, unnest(regexp_extract_all(text, '{quoted}', 2)) AS m, unnest({value}) AS v,
               generate_subscripts(regexp_extract_all(text, '{quoted}', 2), 1) AS i FROM docs))
    WHERE len(v) >= {least}"""


ORACLE = rf"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
base AS ({_spans_sql(0, ASSIGN, 2, 6)} UNION ALL {_spans_sql(1, ACCESS, 0, 20)} UNION ALL {_spans_sql(2, HEX)}),
weak AS (
  SELECT * FROM ({_spans_sql(3, LOGIN, 1, 3)} UNION ALL {_spans_sql(4, OPAQUE)}) w
  WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = w.doc_id AND b.s < w.e AND w.s < b.e)
    AND (kind = 3 OR (regexp_matches(v, '[0-9]') AND regexp_matches(v, '[a-z]') AND regexp_matches(v, '[A-Z]')))
  UNION ALL {_spans_sql(5, HOST)}),
breaks AS ({_spans_sql(6, BREAK)}),
parts AS (SELECT *, kind IN (0, 2, 4) AS secret FROM (SELECT * FROM base UNION ALL SELECT * FROM weak)),
linked AS (
  SELECT w.doc_id, w.kind, w.s, w.e FROM weak w
  WHERE EXISTS (SELECT 1 FROM parts p WHERE p.doc_id = w.doc_id AND p.secret <> (w.kind = 4)
                AND greatest(w.s, p.s) - least(w.e, p.e) <= {GAP}
                AND NOT EXISTS (SELECT 1 FROM breaks b WHERE b.doc_id = w.doc_id AND b.s >= least(w.e, p.e) AND b.e <= greatest(w.s, p.s)))),
names AS (SELECT *, ['assign', 'access', 'hex', 'login', 'opaque', 'host'][kind + 1] || ':' || s || ':' || e AS name FROM (
  SELECT doc_id, kind, s::BIGINT AS s, e::BIGINT AS e FROM base UNION ALL SELECT doc_id, kind, s::BIGINT, e::BIGINT FROM linked)),
found AS (
  SELECT doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
         string_agg(name, ',' ORDER BY s, kind) FILTER (kind < 3) AS base, string_agg(name, ',' ORDER BY s, kind, e) AS spans
  FROM names GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs d LEFT JOIN found f ON d.doc_id = f.doc_id
"""
