"""Document fingerprints: a Merkle tree over the passages and sections of a text, in DataFrame functions only.

Sections are parted by an empty line. A section is cut into passages: lines, and within long lines sentences or runs of at
most ``LONGEST`` characters. A passage's hash is a leaf, a section's hash covers its leaves, the root covers the sections.
Equal roots mean equal texts; differing sections and leaves show where two texts differ.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LONGEST = 160
#: Everything belongs to some passage: words with their end marks and line end, stray end marks, empty lines.
PASSAGE = rf"[^\n.!?]{{1,{LONGEST}}}[.!?]*\n?|[.!?]+\n?|\n"
SHORT = 16


def _short(c: Column) -> Column:
    return F.substring(F.sha2(c.cast("binary"), 256), 1, SHORT)


def leaves_by_section(text: str | Column) -> Column:
    """array<array<string>>: the leaf hashes of each section."""
    sections = F.split(text, "\n\n")
    return F.transform(sections, lambda s: F.transform(F.regexp_extract_all(s, F.lit(PASSAGE), F.lit(0)), _short))


def sections(leaves: str | Column) -> Column:
    """array<struct<hash, leaves>> from the leaf hashes."""
    return F.transform(leaves, lambda own: F.struct(_short(F.concat_ws(".", own)).alias("hash"), own.alias("leaves")))


def root(tree: str | Column) -> Column:
    return F.sha2(F.concat_ws(";", F.transform(tree, lambda s: s["hash"])).cast("binary"), 256)


def fingerprint(tree: str | Column) -> Column:
    """The whole tree as text: root, then for each section its hash and leaves."""
    body = F.transform(tree, lambda s: F.concat(s["hash"], F.lit("="), F.concat_ws(".", s["leaves"])))
    return F.concat(root(tree), F.lit("|"), F.concat_ws(";", body))


def leaf_list(print_: str | Column) -> Column:
    """All leaves of a fingerprint, in order."""
    print_ = F.col(print_) if isinstance(print_, str) else print_
    body = F.split(F.substring(print_, 66, 1 << 30), ";")
    own = F.transform(body, lambda s: F.split(F.substring(s, SHORT + 2, 1 << 30), r"\."))
    return F.filter(F.flatten(own), lambda x: x != "")


def likeness(a: str, b: str) -> Column:
    """Of two fingerprints: 1 for equal roots, else the share of their distinct leaves that both have."""
    x, y = leaf_list(a), leaf_list(b)
    both, either = F.size(F.array_intersect(x, y)), F.size(F.array_union(x, y))
    return F.when(F.substring(a, 1, 64) == F.substring(b, 1, 64), 1.0).when(either == 0, 0.0).otherwise(both / either)


def differing(a: str, b: str) -> Column:
    """array<struct<section, leaf>>: where two fingerprints differ, from the section down to the leaf, both from 0. Sections
    with equal hashes are not entered; a place that only one tree has counts as different."""
    parts = [F.transform(F.split(F.substring(c, 66, 1 << 30), ";"), lambda s: F.split(s, "[=.]")) for c in (a, b)]
    x, y = parts
    places = F.sequence(F.lit(0), F.greatest(F.size(x), F.size(y)) - 1)

    def inside(i):
        p, q = F.coalesce(F.get(x, i), F.array(F.lit(""))), F.coalesce(F.get(y, i), F.array(F.lit("")))
        leaf = F.sequence(F.lit(1), F.greatest(F.size(p), F.size(q), F.lit(2)) - 1)
        apart = F.filter(leaf, lambda k: ~F.get(p, k).eqNullSafe(F.get(q, k)))
        return F.when(F.get(p, F.lit(0)) == F.get(q, F.lit(0)), F.array().cast("array<struct<section:int,leaf:int>>")).otherwise(
            F.transform(apart, lambda k: F.struct(i.cast("int").alias("section"), (k - 1).cast("int").alias("leaf")))
        )

    return F.flatten(F.transform(places, inside))


def with_fingerprint(docs: DataFrame, text: str = "text", name: str = "fingerprint") -> DataFrame:
    """``docs`` with the fingerprint of a text column; a null text counts as empty."""
    tree = sections(leaves_by_section(F.coalesce(F.col(text), F.lit(""))))
    return docs.withColumn("_tree", tree).withColumn(name, fingerprint("_tree")).drop("_tree")


def _part(key: Column, cuts: list[int]) -> Column:
    """How many cut points lie below the key, by halving; -1 for a null key."""
    if not cuts:
        return F.when(key.isNull(), -1).otherwise(0)
    at = F.array(*[F.lit(c) for c in cuts])
    steps = [1 << k for k in range(len(cuts).bit_length() - 1, -1, -1)]
    found = F.aggregate(
        F.array(*[F.lit(s) for s in steps]),
        F.lit(0),
        lambda lo, s: F.when((lo + s <= len(cuts)) & (F.get(at, lo + s - 1) < key), lo + s).otherwise(lo),
    )
    return F.when(key.isNull(), -1).otherwise(found)


def with_next(docs: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """``docs`` with ``next_<column>`` from the row that follows in descending order of the key; the first follows the last.

    Rows of one key follow each other by the hash of their text; null keys come last. The table is cut into key ranges;
    each range also gets a copy of the first row of the range below it, so every row finds its successor inside its range.
    """
    spark = docs.sparkSession
    parts = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    shares = [k / parts for k in range(1, parts)]
    cuts = docs.agg(F.percentile_approx(key, shares, 10_000)).first()[0] or []
    ranged = docs.withColumn("_part", _part(F.col(key), sorted(set(cuts))))
    tops = {r["_part"]: r["_top"] for r in ranged.groupBy("_part").agg(F.max(key).alias("_top")).collect()}  # a row for each range
    order = sorted(tops)
    wanted = spark.createDataFrame([(p, tops[p], order[k + 1 if k + 1 < len(order) else 0]) for k, p in enumerate(order)], f"_from int, _top {docs.schema[key].dataType.simpleString()}, _to int")
    firsts = ranged.join(F.broadcast(wanted), (F.col("_part") == F.col("_from")) & F.col(key).eqNullSafe(F.col("_top")))
    firsts = firsts.withColumn("_n", F.row_number().over(Window.partitionBy("_part").orderBy(F.xxhash64("text")))).where("_n = 1")
    extra = firsts.select(*docs.columns, F.col("_to").alias("_part"), F.lit(1).alias("_extra"))
    rows = ranged.withColumn("_extra", F.lit(0)).unionByName(extra)
    follow = Window.partitionBy("_part").orderBy("_extra", F.desc_nulls_last(key), F.xxhash64("text"))
    return rows.select("*", *[F.lead(c).over(follow).alias(f"next_{c}") for c in columns]).where("_extra = 0").drop("_part", "_extra")


def compare_edits(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """For every row: ``key``, ``n_chars``, ``edited_sha256``, ``fingerprint``, ``edited_fingerprint``, ``near_edited``,
    ``near_next``.

    The edited text ends with the beginning of the next document in descending key order instead of its own second half.
    Null texts are empty; a single row is its own successor; an empty table gives an empty result; other columns are not
    read. Keys are identifiers: rows that repeat one are compared in the order of :func:`with_next`.
    """
    rows = docs.select(F.col(key), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("tree", leaves_by_section("text"))
    rows = with_next(rows, key, ["text", "tree"])
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    rows = rows.select(key, n.cast("long").alias("n_chars"), "tree", "next_tree", F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half)).alias("edited"))
    rows = rows.select("*", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), leaves_by_section("edited").alias("edited_tree"))
    prints = {"fingerprint": "tree", "edited_fingerprint": "edited_tree", "next_fingerprint": "next_tree"}
    rows = rows.select(key, "n_chars", "edited_sha256", *[sections(c).alias(c) for c in prints.values()])
    rows = rows.select(key, "n_chars", "edited_sha256", *[fingerprint(c).alias(name) for name, c in prints.items()])
    return rows.select(
        key,
        "n_chars",
        "edited_sha256",
        "fingerprint",
        "edited_fingerprint",
        likeness("fingerprint", "edited_fingerprint").alias("near_edited"),
        likeness("fingerprint", "next_fingerprint").alias("near_next"),
    )


_TREE_SQL = """list_transform(string_split({0}, chr(10) || chr(10)), lambda s: list_transform(regexp_extract_all(s,
      '[^\\n.!?]{{1,160}}[.!?]*\\n?|[.!?]+\\n?|\\n'), lambda p: substr(sha256(p), 1, 16)))"""

ORACLE = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
n AS (
  SELECT doc_id, text, length(text) AS n,
    coalesce(lead(text) OVER (ORDER BY doc_id DESC), first_value(text) OVER (ORDER BY doc_id DESC)) AS next FROM d),
e AS (SELECT *, substr(text, 1, n - n // 2) || substr(next, 1, n // 2) AS edited FROM n),
t AS (
  SELECT doc_id, n, sha256(edited) AS edited_sha256, {_TREE_SQL.format('text')} AS a, {_TREE_SQL.format('edited')} AS b, {_TREE_SQL.format('next')} AS c
  FROM e),
h AS (
  SELECT *, list_transform(a, lambda l: substr(sha256(array_to_string(l, '.')), 1, 16)) AS ha,
    list_transform(b, lambda l: substr(sha256(array_to_string(l, '.')), 1, 16)) AS hb,
    list_transform(c, lambda l: substr(sha256(array_to_string(l, '.')), 1, 16)) AS hc FROM t),
r AS (
  SELECT *, sha256(array_to_string(ha, ';')) AS ra, sha256(array_to_string(hb, ';')) AS rb, sha256(array_to_string(hc, ';')) AS rc,
    list_distinct(flatten(a)) AS la, list_distinct(flatten(b)) AS lb, list_distinct(flatten(c)) AS lc FROM h)
SELECT doc_id, CAST(n AS BIGINT) AS n_chars, edited_sha256,
  ra || '|' || array_to_string(list_transform(list_zip(ha, a), lambda z: z[1] || '=' || array_to_string(z[2], '.')), ';') AS fingerprint,
  rb || '|' || array_to_string(list_transform(list_zip(hb, b), lambda z: z[1] || '=' || array_to_string(z[2], '.')), ';') AS edited_fingerprint,
  CASE WHEN ra = rb THEN 1.0::DOUBLE WHEN len(list_distinct(la || lb)) = 0 THEN 0.0 ELSE len(list_intersect(la, lb))::DOUBLE / len(list_distinct(la || lb)) END AS near_edited,
  CASE WHEN ra = rc THEN 1.0::DOUBLE WHEN len(list_distinct(la || lc)) = 0 THEN 0.0 ELSE len(list_intersect(la, lc))::DOUBLE / len(list_distinct(la || lc)) END AS near_next
FROM r
"""
