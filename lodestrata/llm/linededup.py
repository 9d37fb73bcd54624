"""Line dedup by an exact set-similarity join, in DataFrame functions only.

A line is the set of its words (lower-cased, set apart by blanks and control characters).  A line is removed if an
earlier line (by doc_id, then line number) of any document has a Jaccard similarity of ``SIMILARITY`` or more with it,
whether or not that earlier line is itself removed.

1. Each line's words become a set of ``HASH_BITS``-bit hashes.  They are ordered by rarity: by the
   magnitude of the corpus count of their hash bucket (of ``BUCKETS``), then by their hash.  Any order that all lines
   share makes the filters exact; this one needs a table of fixed size only.
2. Equal sets collapse to a class with its first occurrence; all but the first go.
3. Prefix filter: two sets within the limit share a word among the rarest |x| - ceil(t |x|) + 1 of each (of the smaller
   set |y| - ceil(2t / (1 + t) |y|) + 1 are enough).  These words are the join key.  The length filter, the positional
   filter and parity signatures (whose differing bits can't exceed the words in which two sets differ) are
   conditions of the join, so pairs that fail never leave it.  Sets too small to be similar to any but an equal one
   stay out of the index.
4. In a word with more than ``LED`` classes each is first compared with the earliest one.  In a group of near copies
   that settles nearly all, and what is settled isn't looked up again, so the pairs of a large group are never listed.
   Then classes of a word with up to ``CROWD`` of them are compared with each other at once, the smaller set by its
   first words only and a part of the words after the other.  Classes of more crowded words that no step settles are
   joined with all earlier ones, by word and step of size, which spreads one word over several keys.
5. The pairs of each step are verified on the hashes of all words: a line's earliest candidate first, the others if
   that one isn't similar.

Defined results: lines without words stay.  A null text has no lines that could match, and stays null; an empty text is
one line without words; an empty table gives no rows.  A very long text is split into its lines where it is read, and a
very long line is one set.  Rows without an id neither remove lines nor lose any.  Rows that repeat an id are taken for
one document: what one keeps, all keep.  Ties can't occur: of equal sets the first stays.  Further columns, whatever
their names, are carried in a struct and come back as they were.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.common import BROADCAST_ROWS, any_of, cut, drop, small

SIMILARITY, BUCKETS = 0.8, 1 << 18
#: Bits of a word's hash; two of the words of two lines of 50 have the same with a chance of 2e-11.
HASH_BITS = 48
#: Bits of the hash in a word's key; above them is the magnitude of its bucket's count.
LOW_BITS = 57
#: Classes of one word from which the earliest one is tried first, and up to which all are compared with each other at once.
LED, CROWD = 256, 1024
#: Words from which a set has a second signature.
LONG = 64
#: Parts of the words, by a hash's last bits (a power of two), compared one after the other: less lies on disk at once.
PASSES = 2
_SLACK = 1e-9
_FIELDS = ("doc", "line", "size", "sig", "sig2", "pos", "gone")
_BREAKS = "\t\r\x0b\x0c"
#: Fixed value: the hash of the empty text.
_NO_WORD = (-7444071767201028348 & (1 << 64) - 1) >> (64 - HASH_BITS)


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _hash(word: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(word), 64 - HASH_BITS)


def word_hashes(line: Column) -> Column:
    """The hashes of the distinct words of a line whose breaks are blanks and whose letters are small."""
    hashes = F.transform(F.split(line, " "), _hash)
    return F.array_remove(F.array_distinct(hashes), _NO_WORD)


def _blanks(text: Column) -> Column:
    """With blanks for the other breaks; few texts have any, and looking costs much less than translating."""
    return F.when(any_of([F.contains(text, F.lit(b)) for b in _BREAKS]), F.translate(text, _BREAKS, " " * len(_BREAKS))).otherwise(text)


def _plain(text: Column) -> Column:
    return F.lower(_blanks(F.coalesce(text, F.lit(""))))


def _known(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Documents with an id; of rows that repeat one, every text counts."""
    return docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("_t"))


def line_sets(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc, line, words (hashes) of every line with words."""
    lines = _known(docs, id_col, text_col).select("doc", F.posexplode(F.split(_plain(F.col("_t")), "\n")).alias("line", "_text"))
    return lines.where(F.trim("_text") != "").select("doc", "line", word_hashes(F.col("_text")).alias("words"))  # a condition on the sets would make them twice


def _all_words(rows: DataFrame) -> DataFrame:
    """h: the hash of every word of the texts."""
    words = F.explode(F.split(F.replace(_plain(F.col("_t")), F.lit("\n"), F.lit(" ")), " "))
    return rows.select(words.alias("w")).where("w <> ''").select(_hash(F.col("w")).alias("h"))


def _magnitudes(words: DataFrame) -> Column:
    """For each hash bucket the binary logarithm of its words' count, as a constant array: a table of fixed size."""
    counts = words.groupBy(_bucket(F.col("h")).alias("b")).agg(F.count(F.lit(1)).alias("n"))
    all_buckets = counts.union(words.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("b"), F.lit(0).cast("long").alias("n"))).groupBy("b").agg(F.sum("n").alias("n"))
    magnitude = F.floor(F.log2(F.col("n") + 1)).cast("string")
    blocks = all_buckets.groupBy(F.shiftright("b", 10).alias("block")).agg(F.sort_array(F.collect_list(F.struct("b", magnitude.alias("m")))).alias("x"))
    parts = blocks.select("block", F.array_join("x.m", ",").alias("m")).orderBy("block").collect()  # BUCKETS / 1024 rows
    return F.split(F.lit(",".join(r["m"] for r in parts)), ",").cast("array<bigint>")  # folded to a constant once


def _bucket(h: Column) -> Column:
    return F.shiftrightunsigned(h, HASH_BITS - (BUCKETS - 1).bit_length()).cast("int")


def _ceil(x: Column) -> Column:
    return F.ceil(x - F.lit(_SLACK)).cast("int")


def _parity(keys: Column, half: bool) -> Column:
    """A bit for each value of six bits of the keys: whether an odd number of the words (or of those with a seventh bit) has it."""
    one = (lambda k: k.bitwiseAND(F.lit(1))) if half else (lambda k: F.lit(1).cast("long"))
    return F.aggregate(keys, F.lit(0).cast("long"), lambda a, k: a.bitwiseXOR(F.call_function("shiftleft", one(k), F.shiftright(k, 1).bitwiseAND(F.lit(63)).cast("int"))))


def classes(sets: DataFrame, similarity: float = SIMILARITY, words: DataFrame | None = None) -> DataFrame:
    """One row per distinct set: first (doc, line), size, sig, sig2, prefix (the keys of its rarest words, rarest first).

    ``words`` (h) are counted for the order; without them, those of the sets.
    """
    place = _magnitudes(sets.select(F.explode("words").alias("h")) if words is None else words)
    magnitude = lambda h: F.coalesce(F.get(place, _bucket(h)), F.lit(0).cast("long"))  # noqa: E731 - never null, so that the keys are sorted as numbers
    keyed = sets.select("doc", "line", F.sort_array(F.transform("words", lambda h: F.shiftleft(magnitude(h), LOW_BITS).bitwiseOR(h))).alias("_keys"))
    size = F.size("_keys")
    made = keyed.select("doc", "line", size.alias("size"), _parity(F.col("_keys"), False).alias("sig"), F.when(size > LONG, _parity(F.col("_keys"), True)).otherwise(F.lit(0).cast("long")).alias("sig2"), F.xxhash64("_keys").alias("id"), F.xxhash64(F.lit(1), F.col("_keys")).alias("id2"), F.slice("_keys", F.lit(1), size - _ceil(size * similarity) + 1).alias("prefix"))
    found = made.groupBy("id", "id2").agg(F.min(F.struct("doc", "line")).alias("first"), *[F.first(c).alias(c) for c in ("size", "sig", "sig2", "prefix")])
    return found.select("first.doc", "first.line", "size", "sig", "sig2", "prefix")


def _index(found: DataFrame, t: float, prefix: Column | None = None) -> DataFrame:
    """A row for each word of a prefix; without classes whose size only equal sets could match."""
    prefix = F.col("prefix") if prefix is None else prefix
    matchable = (F.floor(F.col("size") / t + F.lit(_SLACK)) > F.col("size")) | (_ceil(F.col("size") * t) < F.col("size"))
    return found.where(matchable).select("doc", "line", "size", "sig", "sig2", "gone", F.posexplode(prefix).alias("pos", "key"))


def _side(index: DataFrame, side: str, *more: str) -> DataFrame:
    return index.select("key", *[F.col(n).alias(f"{side}_{n}") for n in _FIELDS], *more)


def _earlier() -> Column:
    """Whether y comes before x."""
    return (F.col("y_doc") < F.col("x_doc")) | ((F.col("y_doc") == F.col("x_doc")) & (F.col("y_line") < F.col("x_line")))


def _short(size: Column, t: float) -> Column:
    """Words of the smaller set beyond the first that are enough."""
    return size - _ceil(size * (2 * t / (1 + t)))


def _close(t: float) -> Column:
    """The filters between the sides x and y of a join."""
    c = F.col
    total = c("x_size") + c("y_size")
    need = _ceil(total * (t / (1 + t)))
    short, long_ = F.least("x_size", "y_size"), F.greatest("x_size", "y_size")
    apart = total - need * 2
    one, two = c("x_sig").bitwiseXOR(c("y_sig")), c("x_sig2").bitwiseXOR(c("y_sig2"))
    signatures = (F.bit_count(one) <= apart) & ((c("x_size") <= LONG) | (c("y_size") <= LONG) | (F.bit_count(one.bitwiseXOR(two)) + F.bit_count(two) <= apart))
    positions = F.least(c("x_size") - c("x_pos"), c("y_size") - c("y_pos")) >= need - F.least("x_pos", "y_pos")
    smaller = F.when(c("x_size") <= c("y_size"), c("x_pos")).otherwise(c("y_pos"))
    return signatures & (short >= _ceil(long_ * t)) & (smaller <= _short(short, t)) & positions


def _at_once(index: DataFrame, short: DataFrame, t: float) -> DataFrame:
    """Close pairs of all classes of each word whose later one isn't gone: y, the smaller set, by its first words only; then x the later one."""
    c = F.col
    stays = ~F.when(_earlier(), c("x_gone")).otherwise(c("y_gone"))
    found = _side(index, "x").join(_side(short, "y"), "key").where(((c("y_size") < c("x_size")) | ((c("y_size") == c("x_size")) & _earlier())) & _close(t) & stays)
    later = lambda n: F.when(_earlier(), c(f"x_{n}")).otherwise(c(f"y_{n}")).alias(f"x_{n}")
    earlier = lambda n: F.when(_earlier(), c(f"y_{n}")).otherwise(c(f"x_{n}")).alias(f"y_{n}")
    return found.select(later("doc"), later("line"), earlier("doc"), earlier("line")).distinct()


def _step(size: str, t: float) -> Column:
    """Sizes of similar sets are in the same step or in neighbouring ones."""
    return F.col(size) if t >= 1 else F.floor(F.log(F.col(size)) / math.log((1 + 1e-6) / t)).cast("int")


_PAIR = ("x_doc", "x_line", "y_doc", "y_line")


def _verified(pairs: DataFrame, rows: DataFrame, t: float) -> DataFrame:
    """doc, line of the pairs' later lines whose sets are similar, by the hashes of all their words."""
    asked = pairs.select(F.col("x_doc").alias("doc"), F.col("x_line").alias("line")).union(pairs.select("y_doc", "y_line")).distinct()
    wanted = cut(asked.groupBy("doc").agg(F.collect_list("line").alias("lines")), "wanted")  # lines of one document
    split = rows.join(small(wanted, wanted.count()), "doc").select("doc", "lines", F.split(_plain(F.col("_t")), "\n").alias("_all"))
    picked = split.select("doc", F.explode(F.transform("lines", lambda k: F.struct(k.alias("line"), F.get("_all", k).alias("text")))).alias("x"))
    found = cut(picked.where("trim(x.text) <> ''").select("doc", "x.line", word_hashes(F.col("x.text")).alias("words")).dropDuplicates(), "sets")
    x, y = (found.select(*[F.col(c).alias(f"{s}_{c}") for c in ("doc", "line", "words")]) for s in "xy")
    both = pairs.join(x, ["x_doc", "x_line"]).join(y, ["y_doc", "y_line"])
    common = F.size(F.array_intersect("x_words", "y_words"))
    alike = common >= (F.size("x_words") + F.size("y_words") - common) * t - _SLACK
    out = cut(both.where(alike).select(F.col("x_doc").alias("doc"), F.col("x_line").alias("line")).distinct(), "alike")
    drop(wanted, found)
    return out


def _settled(pairs: DataFrame, rows: DataFrame, t: float) -> DataFrame:
    """As ``_verified``: each line's earliest candidate first, the others only of lines that this doesn't settle.

    Of a group of near copies nearly all go with the first, so its pairs are not verified one by one.
    """
    line = ["x_doc", "x_line"]
    first = cut(pairs.groupBy(*line).agg(F.min(F.struct("y_doc", "y_line")).alias("y")).select(*line, "y.*"), "earliest")
    gone = _verified(first, rows, t)
    open_ = first.join(gone.toDF(*line), line, "left_anti").toDF(*line, "_doc", "_line")
    left = cut(pairs.join(open_, line).where((F.col("y_doc") != F.col("_doc")) | (F.col("y_line") != F.col("_line"))).select(*_PAIR).distinct(), "left")
    both = gone.union(_verified(left, rows, t))
    drop(first, left)
    return both


def kept_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """_id and kept: the numbers of the document's lines (with words) that have no earlier match; documents without any are left out."""
    t, rows = similarity, _known(docs, id_col, text_col)
    made = cut(classes(line_sets(docs, id_col, text_col), t, _all_words(rows)), "classes")
    found, done = made.withColumn("gone", F.lit(False)), [made]
    index = _index(found, t)
    maybe = F.shiftright("key", LOW_BITS) >= (min(LED, CROWD) + 1).bit_length() - 1  # of rarer buckets no word can have as many classes
    led = cut(index.where(maybe).groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > min(LED, CROWD)), "led")
    done.append(led)
    n_led, n_crowded = led.agg(F.count(F.lit(1)), F.count_if(F.col("n") > CROWD)).first()
    gone = None
    if n_led:
        many = cut(index.where(maybe).join(small(led, n_led), "key"), "many")
        first = many.groupBy("key").agg(F.min(F.struct(*_FIELDS)).alias("y")).select("key", *[F.col(f"y.{n}").alias(f"y_{n}") for n in _FIELDS])
        with_first = cut(_side(many, "x").join(small(first, n_led), "key").where(_earlier() & _close(t)).select(*_PAIR).distinct(), "first")
        gone = _settled(with_first, rows, t)
        done += [many, with_first]
        n_gone = gone.count()
        found = made.join(small(gone.withColumn("gone", F.lit(True)), n_gone), ["doc", "line"], "left").fillna(False, ["gone"])
        if n_gone > BROADCAST_ROWS:
            done.append(found := cut(found, "marked"))
        index = _index(found, t)
    shorter = _index(found, t, F.slice("prefix", F.lit(1), _short(F.col("size"), t) + 1))
    crowd = small(led.where(F.col("n") > CROWD).select("key"), n_crowded)
    modest, short = (x.join(crowd, "key", "left_anti") if n_crowded else x for x in (index, shorter))
    part = lambda x, p: x.where(F.col("key").bitwiseAND(PASSES - 1) == p)
    passes = [cut(_at_once(part(modest, p), part(short, p), t), "pairs") for p in range(PASSES)]
    once = cut(reduce(DataFrame.union, passes).distinct(), "once")  # words of several parts may have the same pair
    done += [*passes, once]
    settled = _settled(once, rows, t)
    gone = settled if gone is None else gone.union(settled)
    if n_crowded:
        many = many.where(F.col("n") > CROWD)
        near = F.explode(F.array(*[_step("x_size", t) + F.lit(k) for k in (-1, 0, 1)]))
        open_ = _side(many.join(gone, ["doc", "line"], "left_anti"), "x").select("*", near.alias("step"))
        rest = cut(open_.join(_side(many, "y").withColumn("step", _step("y_size", t)), ["key", "step"]).where(_earlier() & _close(t)).select(*_PAIR).distinct(), "rest")
        gone = gone.union(_settled(rest, rows, t))
        done.append(rest)
    stay = made.select("doc", "line").join(gone, ["doc", "line"], "left_anti")
    kept = cut(stay.groupBy(F.col("doc").alias("_id")).agg(F.array_sort(F.collect_list("line")).alias("kept")), "kept")  # lines of one document
    drop(*done)
    return kept


def line_decisions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """One row per row of ``docs``: _id, n_lines, n_removed, kept_lines (those without words included)."""
    kept = kept_lines(docs, id_col, text_col, similarity)
    lines = split_lines(F.col(text_col))
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.size(lines).alias("n_lines"), _empty(lines).alias("_empty"))
    stays = F.when(F.col("_id").isNull(), F.sequence(F.lit(0), F.col("n_lines") - 1)).otherwise(F.array_sort(F.array_distinct(F.concat("_empty", F.filter(F.coalesce("kept", F.array().cast("array<int>")), lambda k: k < F.col("n_lines"))))))
    out = rows.join(kept, "_id", "left").withColumn("kept_lines", stays)
    return out.select("_id", F.col("n_lines").cast("long").alias("n_lines"), (F.col("n_lines") - F.size("kept_lines")).cast("long").alias("n_removed"), "kept_lines")


def _blank(line: Column) -> Column:
    return F.trim(_blanks(line)) == ""


def _empty(lines: Column) -> Column:
    """Numbers of the lines without words."""
    return F.filter(F.transform(lines, lambda x, i: F.when(_blank(x), i)), lambda i: i.isNotNull())


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs``, their texts without the removed lines."""
    kept = kept_lines(docs, id_col, text_col, similarity)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_t")).join(kept, "_id", "left")
    numbers = F.coalesce("kept", F.array().cast("array<int>"))
    stays = lambda x, i: F.array_contains(numbers, i) | _blank(x)
    text = F.when(F.col("_id").isNull() | F.col("_t").isNull(), F.col("_t")).otherwise(F.array_join(F.filter(split_lines(F.col("_t")), stays), "\n"))
    return rows.select(*[(text if c == text_col else F.col("_row").getField(c)).alias(c) for c in docs.columns])
