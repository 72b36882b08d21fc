r"""Line dedup by a log-template tree.

Every line is parsed as a log line: tokens with a digit become `<*>`, and the
line falls into the leaf of its token count and its leading tokens. Within a
leaf a position's token is constant if enough documents have it there, and a
variable field `<*>` otherwise; a line's template is what remains. A template
recurs if enough documents have a line of it and at least `min_constant` of its
positions hold a constant token other than `<*>`, so lines of nothing but
numbers never recur. Enough is `min_docs` documents, and `long_docs` for lines
of `long_tokens` tokens or more: a short line may well be said twice, a passage
is not. Recurring lines are dropped from every document but the first (the
smallest doc_id), so that boilerplate goes and no passage is lost altogether.

Texts are parsed once, into a table of lines in the shared folder; all counts
read the few columns they need from it. Counts are of distinct documents: a
sum over distinct lines, less what documents with several lines of a leaf would
count too often. In a leaf whose every line recurs as it is, each line is its
own template, so only the lines of other leaves are taken apart token by token;
the joins with a leaf's constants are salted by its number of documents. Texts
move once, for the join with the numbers of their dropped lines.

Edge cases: a null text has no lines and stays null; lines of fewer than
`min_tokens` tokens stay; rows that repeat a doc_id are one document and get
equal decisions; a row with a null doc_id is the document of its text, and sorts
after all others; an empty table gives no rows; other columns pass through
whatever their names, but for n_lines and n_dropped, which are replaced, and
n_chars, which becomes the new text's length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideledger.llm.common import SPACE, checkpointed, few, packed, read_table, written

MIN_DOCS = 10
MIN_TOKENS = 3
LONG_TOKENS = 50
LONG_DOCS = 2
LEADING = 3
MIN_CONSTANT = 0.6
FIELD = "<*>"

#: Rows of a leaf or of a frequent line that one task may get.
HOT = 4096
#: Rows (of two numbers) that may be broadcast; more of them are joined by a shuffle.
MAX_BROADCAST = 500_000
SALTS = 16

#: A whole token with a digit; anchored at the token's start, so that a long token is scanned once.
NUMBERED = rf"(?<![^{SPACE}])[^{SPACE}0-9]*+[0-9][^{SPACE}]*+"


def parsed(line: Column) -> Column:
    """The line's tokens with numbered ones generalised, joined by one space."""
    plain = F.when(line.rlike("[0-9]"), F.regexp_replace(line, NUMBERED, FIELD)).otherwise(line)
    uneven = F.contains(line, F.lit("  "))
    for c in "\t\x0b\x0c\r":
        uneven = uneven | F.contains(line, F.lit(c))
    return F.trim(F.when(uneven, F.regexp_replace(plain, rf"[{SPACE}]+", " ")).otherwise(plain))


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def line_table(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_tokens: int = MIN_TOKENS) -> DataFrame:
    """(doc_id, text_hash, nr, n, leaf, key, line) of every line with enough tokens: its number, token count, leaf, parsed form and that form's hash."""
    column = F.col(f"`{text}`")
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.xxhash64(column).alias("text_hash"), F.posexplode(F.transform(lines_of(column), parsed)).alias("nr", "line"))
    n = F.length("line") - F.length(F.replace(F.col("line"), F.lit(" "))) + 1
    leaf = F.xxhash64("n", F.substring_index("line", " ", LEADING))
    return rows.withColumn("n", n).filter(F.col("n") >= min_tokens).withColumn("leaf", leaf).withColumn("key", F.xxhash64("line"))


def _document() -> Column:
    """One number for each document."""
    return F.xxhash64("doc_id", F.when(F.col("doc_id").isNull(), F.col("text_hash")))


def _counted_again(rows: DataFrame, *what: str) -> DataFrame:
    """Minus the times that documents with several of `rows` are counted too often in a sum of n_docs."""
    return rows.groupBy(*what, "doc").agg((1 - F.count("*")).alias("n_docs")).filter("n_docs < 0").drop("doc")


def recurring_lines(lines: DataFrame, min_docs: int = MIN_DOCS, min_constant: float = MIN_CONSTANT, long_tokens: int = LONG_TOKENS, long_docs: int = LONG_DOCS) -> DataFrame:
    """(key, first_doc) of every distinct line, of a table of lines, whose template recurs."""
    enough = F.when(F.col("n") >= long_tokens, long_docs).otherwise(min_docs)
    held = lines.select("leaf", "n", "key", _document().alias("doc"), "doc_id")
    leaves = held.select("leaf", "n", "doc").distinct().groupBy("leaf", "n").agg(F.count("*").alias("leaf_docs")).filter(F.col("leaf_docs") >= enough)
    leaves = checkpointed(leaves.select("leaf", "leaf_docs"))
    narrow = F.broadcast(leaves) if few(leaves, MAX_BROADCAST) else leaves
    of_docs = checkpointed(held.join(narrow, "leaf").distinct())
    counts = of_docs.groupBy("leaf", "leaf_docs", "n", "key").agg(F.count("*").alias("n_docs"), F.min("doc_id").alias("first_doc"))
    counts = checkpointed(counts)
    own = F.col("n_docs") >= enough
    mixed = counts.groupBy("leaf").agg(F.min(own).alias("alike")).filter("not alike").select("leaf")
    mixed = checkpointed(mixed)
    mixed = F.broadcast(mixed) if few(mixed, MAX_BROADCAST) else mixed
    fields = lambda line: F.size(F.filter(F.split(line, " ", -1), lambda t: t == FIELD))
    named = lambda some: lines.join(some, "leaf", "left_semi").groupBy("key", "line").agg(F.count("*").alias("_")).drop("_")

    # leaves of lines that all recur as they are
    whole = counts.join(mixed, "leaf", "left_anti").select("leaf", "key", "n", "first_doc")
    numbered = lines.filter(F.contains("line", F.lit(FIELD))).join(narrow, "leaf", "left_semi").groupBy("key", "line").agg(F.count("*").alias("_"))
    loose = numbered.filter((1 - fields(F.col("line")) / (F.length("line") - F.length(F.replace(F.col("line"), F.lit(" "))) + 1)) < min_constant).select("key")
    whole = whole.join(loose, "key", "left_anti").select("key", "first_doc")

    # leaves with lines to generalise
    distinct = checkpointed(counts.join(mixed, "leaf", "left_semi").join(named(mixed), "key"))
    crowd = of_docs.join(mixed, "leaf", "left_semi").groupBy("leaf", "doc").count().filter("count > 1").drop("count")
    several = checkpointed(of_docs.join(mixed, "leaf", "left_semi").join(crowd, ["leaf", "doc"], "left_semi").select("leaf", "leaf_docs", "n", "key", "doc"))
    split = lambda rows: rows.select(*[c for c in rows.columns if c != "line"], F.posexplode(F.split("line", " ", -1)).alias("pos", "token"))
    tokens = split(distinct)
    again = _counted_again(split(several.join(distinct.select("key", "line"), "key")), "leaf", "leaf_docs", "n", "pos", "token")
    spots = tokens.select("leaf", "leaf_docs", "n", "pos", "token", "n_docs").unionByName(again)
    constant = spots.groupBy("leaf", "leaf_docs", "n", "pos", "token").agg(F.sum("n_docs").alias("docs")).filter(F.col("docs") >= enough)
    salts = F.ceil(F.col("leaf_docs") / HOT).cast("int")
    spread = constant.select("leaf", "pos", "token", F.col("token").alias("kept"), F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))
    marked = tokens.withColumn("salt", F.pmod(F.col("key"), salts).cast("int")).join(spread, ["leaf", "pos", "token", "salt"], "left")
    part = F.struct("pos", F.coalesce("kept", F.lit(FIELD)).alias("t"))
    parts = F.transform(F.array_sort(F.collect_list(part)), lambda p: p["t"])
    share = F.count(F.when(F.col("kept") != FIELD, True)) / F.count("*")
    templates = marked.groupBy("leaf", "n", "key", "n_docs", "first_doc").agg(F.xxhash64(F.array_join(parts, " ")).alias("template"), share.alias("share"))
    filed = checkpointed(templates.filter(F.col("share") >= min_constant))
    more = _counted_again(several.select("key", "doc").join(filed.select("leaf", "n", "template", "key"), "key"), "leaf", "n", "template")
    counted = filed.select("leaf", "n", "template", "n_docs", "first_doc").unionByName(more, allowMissingColumns=True)
    recurring = counted.groupBy("leaf", "n", "template").agg(F.sum("n_docs").alias("docs"), F.min("first_doc").alias("template_first")).filter(F.col("docs") >= enough)
    general = filed.join(recurring.select("leaf", "template", "template_first"), ["leaf", "template"]).select("key", F.col("template_first").alias("first_doc"))
    return whole.unionByName(general)


def drop_recurring(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_docs: int = MIN_DOCS, min_constant: float = MIN_CONSTANT, long_tokens: int = LONG_TOKENS, long_docs: int = LONG_DOCS) -> DataFrame:
    """The documents without recurring lines, and columns n_lines and n_dropped."""
    lines = written(line_table(docs, doc_id, text), "lines")
    recurring = checkpointed(recurring_lines(lines, min_docs, min_constant, long_tokens, long_docs))
    found = lines.select("doc_id", "text_hash", "nr", "key")
    if few(recurring, MAX_BROADCAST):
        again = found.join(F.broadcast(recurring), "key")
    else:
        salted = recurring.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        again = found.withColumn("salt", F.pmod(F.xxhash64("doc_id", "text_hash"), F.lit(SALTS)).cast("int")).join(salted, ["key", "salt"])
    drops = again.filter(~F.col("doc_id").eqNullSafe(F.col("first_doc"))).groupBy(F.col("doc_id").alias("drop_id"), F.col("text_hash").alias("drop_text")).agg(F.sort_array(F.collect_set("nr")).alias("drops"))
    column = F.col(f"row.`{text}`")
    rows = packed(docs).select("row", F.xxhash64(column).alias("text_hash"))
    joined = rows.join(drops, F.col(f"row.`{doc_id}`").eqNullSafe(F.col("drop_id")) & (F.col("text_hash") == F.col("drop_text")), "left")
    # bound to a variable, so that a text is split once
    both = F.struct(lines_of(column).alias("lines"), F.col("drops").alias("drops"))
    left = lambda b: F.array_except(F.sequence(F.lit(0), F.size(b["lines"]) - 1), b["drops"])
    kept = F.transform(F.array(both), lambda b: F.array_join(F.transform(left(b), lambda i: F.get(b["lines"], i)), "\n"))[0]
    cut = F.col("drops").isNotNull()
    joined = joined.withColumn("new_text", F.when(cut, kept).otherwise(column))
    n_lines = F.coalesce(F.length(column) - F.length(F.replace(column, F.lit("\n"))) + 1, F.lit(0))
    values = {text: F.col("new_text"), "n_chars": F.when(cut, F.length("new_text").cast("long")).otherwise(F.col("row.`n_chars`"))}
    names = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    return joined.select(*[values[c].alias(c) if c in values else F.col(f"row.`{c}`") for c in names], n_lines.alias("n_lines"), F.coalesce(F.size(F.when(cut, F.col("drops"))), F.lit(0)).alias("n_dropped"))


def op6_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    return drop_recurring(docs)


#: The documents of a table `docs` without recurring lines, as `deduped` (its columns, n_lines, n_dropped).
DEDUP_SQL = r"""
raw_lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS nr FROM docs WHERE text IS NOT NULL),
all_lines AS (SELECT doc_id, raw, nr, trim(regexp_replace(regexp_replace(raw, '[^\x20\x09-\x0D]*[0-9][^\x20\x09-\x0D]*', '<*>', 'g'), '[\x20\x09-\x0D]+', ' ', 'g'), ' ') AS line FROM raw_lines),
doc_lines AS (SELECT DISTINCT doc_id, line, string_split(line, ' ') AS tokens, CASE WHEN len(string_split(line, ' ')) >= 50 THEN 2 ELSE 10 END AS enough,
              len(string_split(line, ' ')) || ' ' || array_to_string(string_split(line, ' ')[1:3], ' ') AS leaf FROM all_lines WHERE len(string_split(line, ' ')) >= 3),
wide AS (SELECT * FROM doc_lines WHERE leaf IN (SELECT leaf FROM doc_lines GROUP BY leaf HAVING count(DISTINCT doc_id) >= any_value(enough))),
spots AS (SELECT doc_id, leaf, line, enough, unnest(tokens) AS token, generate_subscripts(tokens, 1) AS pos FROM wide),
constants AS (SELECT leaf, pos, token, token <> '<*>' AS fixed FROM spots GROUP BY leaf, pos, token HAVING count(DISTINCT doc_id) >= any_value(enough)),
line_spots AS (SELECT DISTINCT leaf, line, pos, token FROM spots),
templates AS (SELECT s.leaf, s.line, string_agg(CASE WHEN c.fixed THEN s.token ELSE '<*>' END, ' ' ORDER BY s.pos) AS template
              FROM line_spots s LEFT JOIN constants c ON s.leaf = c.leaf AND s.pos = c.pos AND s.token = c.token
              GROUP BY s.leaf, s.line HAVING count(*) FILTER (c.fixed) / count(*) >= 0.6),
recurring AS (SELECT t.leaf, t.template, min(w.doc_id) AS first_doc FROM templates t JOIN wide w ON t.line = w.line
              GROUP BY t.leaf, t.template HAVING count(DISTINCT w.doc_id) >= any_value(w.enough)),
dropped AS (SELECT t.line, r.first_doc FROM templates t JOIN recurring r ON t.leaf = r.leaf AND t.template = r.template),
rebuilt AS (SELECT a.doc_id, count(*)::INTEGER AS n_lines, count(d.line)::INTEGER AS n_dropped,
                   coalesce(string_agg(a.raw, chr(10) ORDER BY a.nr) FILTER (d.line IS NULL), '') AS text
            FROM all_lines a LEFT JOIN dropped d ON a.line = d.line AND a.doc_id IS DISTINCT FROM d.first_doc GROUP BY a.doc_id),
deduped AS (SELECT o.doc_id, r.text, o.lang, o.source, CASE WHEN r.n_dropped > 0 THEN length(r.text) ELSE o.n_chars END AS n_chars,
                   coalesce(r.n_lines, 0) AS n_lines, coalesce(r.n_dropped, 0) AS n_dropped
            FROM docs o LEFT JOIN rebuilt r ON o.doc_id IS NOT DISTINCT FROM r.doc_id)
"""

ORACLE = f"""
WITH docs AS (SELECT doc_id, text, lang, source, n_chars FROM documents), {DEDUP_SQL}
SELECT doc_id, text, lang, source, n_chars, n_lines, n_dropped FROM deduped
"""
