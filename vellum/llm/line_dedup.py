"""Line dedup by an exact set-similarity join; DataFrame functions only.

A line's tokens are its five-word shingles (fewer words: the line itself),
lower-cased; words are parted by blanks.  Lines with equal tokens are one
class.  Tokens are ordered rarest first, by the logarithm of a hashed count,
then by hash; classes that share a
token of their prefixes are compared when length, positional and bit-count
filters leave room for a Jaccard similarity of 0.75, and a later line goes when
any earlier one is that similar.

All lines are cut into tokens once.  Their first tokens by hash are kept and
counted; only lines too full of frequent ones to have their prefix among these
are cut again, one line a class, and all their tokens counted.  Prefixes are
longer by SHARED - 1 tokens than one common token asks for: similar lines have
SHARED in common there, so classes with fewer shared ones are dropped before
their tokens are fetched.

Who goes needs one earlier partner, not all: classes first meet the earliest
class of each shared token, and only those not settled that way meet the rest
of their tokens' classes, so a large group isn't compared pair by pair.  Classes
of frequent tokens carry all their shared ones, and meet at the first they have
in common only.

Tokens are compared by 63-bit hashes.

Defined cases: null texts have no lines and stay null; blank lines are never
removed; lines are in the order of doc_id (nulls last), then text, then place;
rows with equal ids and texts are one document and lose the same lines; a
document that loses all its lines has an empty text; an empty table gives no
rows; very long lines are compared whole; other columns are carried along
whatever their names (one named removed_lines gives way to the result's).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.llm.workspace import discard, materialize, sized

SHINGLE = 5
#: Classes from which on a token is frequent.
CROWD = 64
#: 64-bit words of a line's bitmap.
WORDS = 8
#: Tokens that similar lines have in common in their prefixes (shorter lines: fewer).
SHARED = 3
#: Counters of the rarity sketch.
SKETCH = 1 << 16
#: Rows of a few longs that are broadcast at most; of one long, twice as many.
KEYS = 1_000_000
_LAST = 2**63 - 1


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once: a name inside a lambda would compute it for every element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _shingles(words: Column) -> Column:
    """Hashes of a line's five-word shingles in their order; positive."""
    last = lambda h: F.size(h) - SHINGLE + 1
    window = lambda h: F.transform(F.slice(h, 1, last(h)), lambda x, i: F.xxhash64(x, *(F.get(h, i + k) for k in range(1, SHINGLE))).bitwiseAND(F.lit(_LAST)))
    few = lambda h: F.array(F.xxhash64(h, F.size(h)).bitwiseAND(F.lit(_LAST)))
    return _let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: F.when(F.size(h) >= SHINGLE, window(h)).otherwise(few(h)))


def line_rows(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> d, h, line (where it stands), content, for every line that isn't blank."""
    rows = docs.where("text is not null").select(F.coalesce("doc_id", F.lit(_LAST)).alias("d"), F.xxhash64("text").alias("h"), F.posexplode_outer(F.split("text", "\n", -1)).alias("line", "content"))
    return rows.where(F.trim("content") != "")


def _content_shingles() -> Column:
    return _shingles(F.array_remove(F.split(F.lower("content"), " "), ""))


def _content_tokens() -> Column:
    return F.array_distinct(_content_shingles())


def line_tokens(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> d, h, line, tokens, for every line that isn't blank."""
    return line_rows(docs).select("d", "h", "line", _content_tokens().alias("tokens"))


def _counts(arrays: DataFrame) -> dict[int, int]:
    """arrays(tokens) -> how many tokens each bucket of the sketch gets."""
    counts = arrays.select(F.explode_outer("tokens").alias("t")).groupBy(F.col("t").bitwiseAND(F.lit(SKETCH - 1)).alias("bucket")).count()
    return {r.bucket: r["count"] for r in counts.where("bucket is not null").collect()}  # SKETCH rows at most


def _usual(found: dict[int, int]) -> float:
    """Up to so many tokens chance may put into a bucket."""
    mean = sum(found.values()) / SKETCH
    return mean + 6 * mean**0.5 + 8


def _rarity(found: dict[int, int], usual: float) -> bytes:
    """For each bucket of the sketch a class, 0 to 30: the logarithm of its tokens beyond what chance puts there; SKETCH bytes."""
    return bytes(min(30, int(found.get(i, 0) / usual).bit_length()) for i in range(SKETCH))


def _ordered(tokens: Column, classes: bytes) -> Column:
    """Tokens rarest first: the class of their bucket in the top bits, the rest of the hash below."""
    return F.sort_array(F.transform(tokens, lambda t: F.call_function("shiftleft", _class(t, classes).cast("long"), F.lit(58)).bitwiseOR(F.shiftright(t, 5))))


def _class(token: Column, classes: bytes) -> Column:
    table = F.split(F.lit(",".join(map(str, classes))), ",").cast("array<int>")  # folded to a literal
    return F.get(table, token.bitwiseAND(F.lit(SKETCH - 1)).cast("int"))


def _overlap(n: Column) -> Column:
    """Tokens that a set has in common with a similar one at least."""
    return F.ceil(n * 0.75).cast("int")


def _more(n: Column) -> Column:
    """By how many tokens a prefix is longer so that similar sets have SHARED in common there, or all that they must."""
    return F.least(F.lit(SHARED), _overlap(n)) - 1


def _enough(n: Column) -> Column:
    """Shared tokens in the longer prefix without which no set is similar: as many as for the smallest set that may be."""
    return F.least(F.lit(SHARED), _overlap(_overlap(n)))


def _length(n: Column) -> Column:
    return n - _overlap(n) + 1


def _head(tokens: Column, length: Column) -> Column:
    """The first of sorted tokens, some more than length: most are of class 0 and keep their order."""
    return F.slice(tokens, 1, length + F.shiftright(length, 3) + 2)


def _first(head: Column, n: Column, length: Column, classes: bytes) -> Column:
    """The first of _ordered(tokens), of n tokens with this head; null where the head is too full of frequent ones to tell."""
    whole = F.when(F.size(head) == n, F.slice(_ordered(head, classes), 1, length))
    return _let(F.filter(head, lambda t: _class(t, classes) == 0), lambda u: F.when(F.size(u) >= length, F.transform(F.slice(u, 1, length), lambda t: F.shiftright(t, 5))).otherwise(whole))


def _prefix(tokens: Column, classes: bytes, more: Column | None = None) -> Column:
    """The first of _ordered(tokens) that a similar set must share one of, and more; tokens are sorted."""
    n = F.size(tokens)
    length = _length(n) if more is None else _length(n) + more
    return F.coalesce(_first(_head(tokens, length), n, length, classes), F.slice(_ordered(tokens, classes), 1, length))


def _bits(word: int) -> Column:
    """One word of a bitmap of 512 bits, in which each token t of a group sets one."""
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright("t", 7).bitwiseAND(F.lit(63)).cast("int"))
    return F.bit_or(F.when(F.shiftright("t", 13).bitwiseAND(F.lit(WORDS - 1)) == word, bit).otherwise(F.lit(0).cast("long")))


def removed_lines(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> d, h, line of every line to which an earlier one is similar."""
    tokens, n = F.col("tokens"), F.col("n")
    lines = line_tokens(docs).select("d", "h", "line", F.sort_array(tokens).alias("tokens"))
    lines = lines.select("d", "h", "line", F.size(tokens).alias("n"), F.xxhash64(tokens).alias("id"), _head(tokens, _length(F.size(tokens)) + _more(F.size(tokens))).alias("prefix"))
    sets = materialize(lines, "sets")
    place = F.struct("d", "h", "line")
    first = materialize(sets.groupBy("id").agg(F.min(place).alias("first"), F.count("*").alias("copies")), "classes")
    members = materialize(sets.select("id", "d", "h", "line"), "members")
    prefixes = _prefixes(docs, sets, first)
    discard(sets)

    postings = prefixes.select("id", "n", F.posexplode("prefix").alias("at", "key"))
    shared = postings.groupBy("key").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo <> hi").select("key")
    shared = sized(materialize(shared, "shared"), 2 * KEYS)
    found = materialize(postings.join(shared, "key").groupBy("key", "id").agg(F.first("n").alias("n"), F.first("at").alias("at")), "found")
    for table in prefixes._vellum_parts:
        discard(table)
    able = found.groupBy("id").agg(F.count("*").alias("keys"), F.first("n").alias("n")).where(F.col("keys") >= _enough(n)).select("id")
    able = sized(materialize(able, "able"), KEYS)
    held = found.join(able, "id", "left_semi").where(F.col("at") < _length(n))
    still = held.groupBy("key").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo <> hi").select("key")
    still = sized(materialize(still, "still"), 2 * KEYS)
    near = materialize(held.join(still, "key", "left_semi"), "near")
    discard(found)
    ids = sized(materialize(near.select("id").distinct(), "ids"), KEYS)
    wanted = _spots(first, ids)
    tokens = materialize(_tokens_at(docs, wanted), "tokens")
    bits = [f"s{i}" for i in range(WORDS)]
    signed = tokens.select("id", F.explode("tokens").alias("t")).groupBy("id").agg(*(_bits(i).alias(s) for i, s in enumerate(bits)))
    sigs = materialize(signed.join(wanted.select("id", place.alias("first")), "id"), "signed")

    rows = materialize(_with_common(near).join(sigs, "id"), "rows")
    for table in (near, sigs):
        discard(table)
    of = lambda x: [F.col(f"{s}{x}") for s in bits]
    lead = rows.groupBy("key").agg(F.min(F.struct("first", "id", "n", *bits)).alias("x")).select("key", F.col("x.id").alias("b"), *(F.col(f"x.{c}").alias(f"{c}_b") for c in ("n", *bits)))
    stars = rows.join(lead, "key").where((F.col("id") != F.col("b")) & _fits(F.col("n"), F.col("n_b"), of(""), of("_b"))).select(F.col("id").alias("a"), "b").distinct()
    links = _verified(stars, tokens)
    left = rows.join(links.select(F.col("a").alias("id")).distinct(), "id", "left_anti")
    later, earlier = (part.select("key", *(F.col(c).alias(f"{c}_{x}") for c in ("id", "first", "n", "at", "common", *bits))) for x, part in (("a", left), ("b", rows)))
    both = F.col("n_a") + F.col("n_b")
    room = 1 + F.least(F.col("n_a") - F.col("at_a") - 1, F.col("n_b") - F.col("at_b") - 1) + F.least("at_a", "at_b")
    fits = (7 * room >= 3 * both) & _fits(F.col("n_a"), F.col("n_b"), of("_a"), of("_b")) & (F.col("first_b") < F.col("first_a"))
    fits = fits & (F.col("common_a").isNull() | (F.array_min(F.array_intersect("common_a", "common_b")) == F.col("key")))
    rest = later.join(earlier, "key").where(fits).select(F.col("id_a").alias("a"), F.col("id_b").alias("b")).distinct()
    gone = materialize(links.select("a").union(_verified(rest, tokens).select("a")).distinct(), "gone")
    for table in (rows, tokens):
        discard(table)

    # all lines of a class with an earlier partner go, and all but the first of the others
    fate = first.join(gone.select(F.col("a").alias("id"), F.lit(True).alias("gone")), "id", "left").where("gone or copies > 1").select("id", "first", F.coalesce("gone", F.lit(False)).alias("gone"))
    fate = sized(materialize(fate, "fate"), KEYS // 4)
    return members.join(fate, "id").where(F.col("gone") | (F.struct("d", "h", "line") != F.col("first"))).select("d", "h", "line")


def _spots(first: DataFrame, ids: DataFrame) -> DataFrame:
    """id, d, h, line: where the first line of each of these classes stands."""
    return sized(materialize(first.join(ids, "id", "left_semi").select("id", "first.*"), "spots"), KEYS)


def _tokens_at(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """id, tokens of the lines at wanted(id, d, h, line); of a repeated row, as often."""
    owners = sized(materialize(wanted.select("d", "h").distinct(), "owners"), KEYS)
    held = docs.withColumn("d", F.coalesce("doc_id", F.lit(_LAST))).withColumn("h", F.xxhash64("text")).join(owners, ["d", "h"], "left_semi").select("doc_id", "text")
    return line_rows(held).join(wanted, ["d", "h", "line"]).select("id", _content_tokens().alias("tokens"))


def _prefixes(docs: DataFrame, sets: DataFrame, first: DataFrame) -> DataFrame:
    """sets with the heads of their hash order -> id, n, prefix; the tables that it reads are its _vellum_parts."""
    n, head = F.col("n"), F.col("prefix")
    found = _counts(sets.select(head.alias("tokens")))
    usual = _usual(found)
    told = lambda classes: sets.select("id", "n", _first(head, n, _length(n) + _more(n), classes).alias("prefix"))
    lacking = lambda table: sized(materialize(table.where("prefix is null").select("id").distinct(), "lacking"), KEYS)
    classes = _rarity(found, usual)
    if any(classes):
        ids = lacking(told(classes))
        if not ids.isEmpty():  # what they have beyond their heads may be as frequent
            every = _counts(_tokens_at(docs, _spots(first, ids)))
            classes = bytes(map(max, classes, _rarity(every, usual)))
    parts = [materialize(told(classes), "prefixes")]
    ids = lacking(parts[0])
    if not ids.isEmpty():
        whole = _tokens_at(docs, _spots(first, ids)).select("id", F.sort_array("tokens").alias("tokens"))
        parts.append(materialize(whole.select("id", F.size("tokens").alias("n"), _prefix(F.col("tokens"), classes, _more(F.size("tokens"))).alias("prefix")), "prefixes"))
    out = parts[0].where("prefix is not null")
    for part in parts[1:]:
        out = out.unionByName(part)
    out._vellum_parts = parts
    return out


def _with_common(near: DataFrame) -> DataFrame:
    """near with common: all shared tokens of a class where the row's own is frequent, else null."""
    crowds = sized(materialize(near.groupBy("key").count().where(F.col("count") >= CROWD).select("key"), "crowds"), KEYS)
    hot = near.join(crowds, "key", "left_semi")
    ids = sized(materialize(hot.select("id").distinct(), "crowd_ids"), KEYS)
    every = near.join(ids, "id", "left_semi").groupBy("id").agg(F.collect_list("key").alias("common"))
    cold = near.join(crowds, "key", "left_anti").withColumn("common", F.lit(None).cast("array<long>"))
    return cold.unionByName(hot.join(every, "id"))


def _fits(na: Column, nb: Column, sa: list[Column], sb: list[Column]) -> Column:
    """Length filter, and the bound that bits which differ set on the overlap."""
    apart = sum((F.bit_count(x.bitwiseXOR(y)) for x, y in zip(sa, sb, strict=True)), F.lit(0))
    return (100 * F.least(na, nb) >= 75 * F.greatest(na, nb)) & (na + nb >= 7 * apart)


def _verified(pairs: DataFrame, tokens: DataFrame) -> DataFrame:
    """The pairs (a, b) that are similar; only tokens of their own classes are moved, once for each class."""
    pairs = materialize(pairs, "pairs")
    ids = sized(materialize(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "pair_ids"), KEYS)
    asked = materialize(tokens.join(ids, "id", "left_semi").groupBy("id").agg(F.first("tokens").alias("set")), "asked")
    left, right = (asked.select(F.col("id").alias(x), F.col("set").alias(f"t{x}")) for x in "ab")
    both = F.size(F.array_intersect("ta", "tb"))
    joined = pairs.join(left, "a").join(right, "b")
    links = materialize(joined.where(100 * both >= 75 * (F.size("ta") + F.size("tb") - both)).select("a", "b"), "links")
    discard(asked)
    return links


def dedup_lines(docs: DataFrame) -> DataFrame:
    """documents(doc_id, text, ...) -> the same columns, text without the removed lines, and removed_lines (array of places)."""
    columns = [c for c in docs.columns if c != "removed_lines"]
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in columns)).alias("row"), F.col("text").cast("string").alias("text"))
    rows = rows.select("row", "text", F.coalesce(F.col("row.doc_id").cast("long"), F.lit(_LAST)).alias("d"), F.xxhash64("text").alias("h"))
    gone = removed_lines(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))
    gone = gone.distinct().groupBy("d", "h").agg(F.array_sort(F.collect_list("line")).alias("gone"))
    joined = rows.join(gone, ["d", "h"], "left")
    kept = F.array_join(F.filter(F.transform(F.split("text", "\n", -1), lambda x, i: F.when(~F.array_contains("gone", i), x)), lambda x: x.isNotNull()), "\n")
    text = F.when(F.col("gone").isNotNull(), kept).otherwise(F.col("text")).alias("text")
    return joined.select(*(text if c == "text" else F.col(f"row.`{c}`").alias(c) for c in columns), F.coalesce("gone", F.expr("cast(array() as array<int>)")).alias("removed_lines"))
