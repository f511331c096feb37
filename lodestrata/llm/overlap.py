"""Same or almost the same records across splits (problem 1).

Texts are reduced to words and collapsed to distinct ones, each with the sides (train, or one of the
other splits) that hold it. A sparse suffix array brings texts of the two sides together: its
suffixes begin at the rarest words of each text, and it is partitioned by the text's numbers.
Suffixes of both sides that begin alike are extended along their common prefixes; the spans that two
texts share that way are merged, and the words that lie in none of them are counted. Documents are
compared by the texts that are linked so.

Two texts are alike if at most a fifth of the longer one's words lie outside of shared spans (a word
that stands for another counts once), so a text of fewer than five words has no room for a change.
Numbers count more, since another number says something else: all of them must lie in shared spans,
and where there are ten or more, all but a tenth. In texts of fewer than ten words no word may stand
for another, since a title of another firm or measure is no copy; but one word may be one slip away.

Which suffixes have to be there: if at most d words of a text are outside of the spans, one of its
d + 1 rarest words is inside, and the rarest word that both texts hold is among those of either. So
no pair is missed, and suffixes at more frequent words aren't needed.

Pairs of fewer than ten words need none of this. What differs is one word, so they are brought
together by the text without it, or with one letter of it left out: titles that share all but the
firm's name would otherwise all meet, and their pairs grow with the square of the data.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator, Sequence
from functools import partial, reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from lodestrata.llm.deliveries import latest_delivery
from lodestrata.functions.quantities import one_slip
from lodestrata.llm.figures import figure
from lodestrata.llm.names import split_name
from lodestrata.session import cut as _cut

cut = partial(_cut, release=True)

#: Share of the words of either text that must lie in shared spans.
COVERAGE = 0.8
#: Share of the numbers that must, in texts of MANY numbers or more.
NUMBERS_COVERAGE, MANY = 0.9, 10
#: Words below which no word may stand for another.
SHORT = 10
#: Numbers in a row that texts of MANY numbers share at least: nine or more, of which a tenth is lost.
RUN = 5

#: A number with its inner dots, or letters; loose dots are blanked first, since a pattern that
#: repeats a group would recurse in Java and exhaust its stack on long lists of numbers.
_LOOSE_DOTS = r"\.(?!\p{N})|(?<!\p{N})\."
_WORDS_JAVA = r"[\p{N}.]+|[\p{L}\p{M}]+"


def words_of(text: Column) -> Column:
    """Words of a text: lower case, thousands unmarked, tags and punctuation left out."""
    s = F.regexp_replace(F.lower(text), r"<[^<>]{0,300}>", " ")
    s = F.regexp_replace(F.regexp_replace(s, r"(?<=\d),(?=\d{3}(?!\d))", ""), _LOOSE_DOTS, " ")
    return F.regexp_extract_all(s, F.lit(_WORDS_JAVA), F.lit(0))


def numbers_of(line: Column) -> Column:
    """The words of a line that are numbers, in order."""
    return F.filter(F.split(line, " "), lambda w: w.rlike(r"^\p{N}"))


def _lost(n: int) -> int:
    """Words of a text of n that may lie outside of shared spans."""
    return int((1 - COVERAGE) * n + 1e-9)


def _lost_numbers(m: int) -> int:
    return int((1 - NUMBERS_COVERAGE) * m + 1e-9) if m >= MANY else 0


def _number(word: str) -> bool:
    return word[0].isdecimal() if word[0].isascii() else unicodedata.category(word[0])[0] == "N"


def outside_spans(a: Sequence[str], b: Sequence[str], most: int) -> int:
    """Words outside of the spans that a and b share in order, or most + 1 if there are more.

    A span is extended along a diagonal by the common prefix of two suffixes; each step to another
    diagonal leaves one word of either text, or one of both, outside.
    """
    n, m = len(a), len(b)
    if abs(n - m) > most:
        return most + 1

    def extended(i: int, shift: int) -> int:
        while i < n and i + shift < m and a[i] == b[i + shift]:
            i += 1
        return i

    reached = {0: extended(0, 0)}
    for lost in range(most + 1):
        if reached.get(m - n, -1) >= n:
            return lost
        further: dict[int, int] = {}
        for shift in range(max(-lost - 1, -n), min(lost + 1, m) + 1):
            steps = [reached[s] + on for s, on in ((shift, 1), (shift - 1, 0), (shift + 1, 1)) if s in reached]
            at = max((min(i, n, m - shift) for i in steps), default=-1)
            if at >= 0 and at + shift >= 0:
                further[shift] = extended(at, shift)
        reached = further
    return most + 1


def alike(a: Sequence[str], b: Sequence[str], short: int = SHORT) -> bool:
    """Whether the spans that two texts share cover both of them, by the rules above; short is the number of words below which no word may stand for another."""
    if a == b:
        return bool(a)
    n, m = len(a), len(b)
    longer, start, end = max(n, m), 0, 0
    # what both begin and end with are spans
    while start < min(n, m) and a[start] == b[start]:
        start += 1
    while end < min(n, m) - start and a[n - 1 - end] == b[m - 1 - end]:
        end += 1
    x, y = a[start : n - end], b[start : m - end]
    if any(map(_number, x)) or any(map(_number, y)):
        numbers = [[w for w in words if _number(w)] for words in (a, b)]
        lost = _lost_numbers(max(map(len, numbers)))
        if numbers[0] != numbers[1] and (not lost or outside_spans(*numbers, lost) > lost):
            return False
    if longer < short:
        if n == m:
            return n > 1 and len(x) == 1 and len(x[0]) > 3 and not _number(x[0]) and one_slip(x[0], y[0])
        # only words left out of one of them
        return abs(n - m) == outside_spans(x, y, _lost(longer)) <= _lost(longer)
    return max(len(x), len(y)) <= _lost(longer) or outside_spans(x, y, _lost(longer)) <= _lost(longer)


def _meeting_short(held: DataFrame) -> DataFrame:
    """(x, y): ids of all pairs of fewer than SHORT words that may be alike, and of few others.

    held: (id, line, in_train, in_eval, n, ...). Either one word is a slip away, so that both have a
    letter left out in the same place of the same words or one of them has, or the longer one, of
    which at most one word may be lost, has a word left out.
    """
    words = F.split("line", " ")
    at = lambda start, length: F.array_join(F.slice(words, start, length), " ")

    def changed(i: Column, to: Column) -> Column:
        return F.xxhash64(F.concat_ws("\t", at(F.lit(1), i), to, at(i + 2, F.size(words))))

    def slips(i: Column) -> Column:
        word = F.get(words, i)
        spelled = F.transform(F.sequence(F.lit(0), F.length(word)), lambda j: changed(i, F.concat(F.substr(word, F.lit(1), j), F.substr(word, j + 2))))
        return F.when(word.rlike(r"^\p{N}") | (F.length(word) < 3), F.array().cast("array<bigint>")).otherwise(spelled)

    def left_out(i: Column) -> Column:
        return F.xxhash64(F.concat_ws(" ", F.filter(F.array(at(F.lit(1), i), at(i + 2, F.size(words))), lambda s: s != "")))

    places = F.sequence(F.lit(0), F.size(words) - 1)
    few = held.where(F.col("n") < SHORT)

    def rows(marks: Column, flag: str, name: str) -> DataFrame:
        return few.where(flag).select(F.col("id").alias(name), F.explode(F.array_distinct(marks)).alias("part"))

    slip = F.flatten(F.transform(places, slips))
    lacking = F.when(F.col("n") * (1 - COVERAGE) + 1e-9 >= 1, F.transform(places, left_out)).otherwise(F.array().cast("array<bigint>"))
    whole = F.array(F.xxhash64("line"))
    return reduce(DataFrame.unionByName, [rows(a, "in_train", "x").join(rows(b, "in_eval", "y"), "part").select("x", "y") for a, b in ((slip, slip), (lacking, whole), (whole, lacking))])


_LINK = T.StructType([T.StructField("x", T.BinaryType()), T.StructField("y", T.BinaryType())])


def _judged(batches: Iterator[pa.RecordBatch], short: int) -> Iterator[pa.RecordBatch]:
    """(x, y) of the (x, y, a, b) whose joined words a and b are alike."""
    for batch in batches:
        # a text meets many others, so each is cut into words once
        sides = [batch.column(c).dictionary_encode() for c in ("a", "b")]
        words = [[line.split(" ") for line in side.dictionary.to_pylist()] for side in sides]
        keep = [alike(words[0][i], words[1][j], short) for i, j in zip(*(side.indices.to_pylist() for side in sides))]
        yield batch.select(["x", "y"]).filter(pa.array(keep, pa.bool_()))


def text_links(texts: DataFrame, short: int = SHORT) -> DataFrame:
    """(x, y): texts x of the train side and different texts y of the other that are alike.

    texts: distinct (text_key, line, in_train, in_eval); line is the words, joined by blanks. Texts
    without words are alike to none.
    """
    words = F.split("line", " ")
    numbers = numbers_of(F.col("line"))
    held = texts.where(F.col("line") != "").withColumn("numbers", numbers).withColumn("lead", F.xxhash64(F.array_join("numbers", " ")))
    n = F.size(words)
    # of the longer text, which is at most a quarter longer; a slip in a short one is a word outside
    room = F.greatest(F.lit(1), F.floor((1 - COVERAGE) * F.floor(n / F.lit(COVERAGE) + 1e-9) + 1e-9)).cast("int")

    mark = lambda w: F.xxhash64(w)
    marks = F.transform(F.array_distinct(words), mark)
    # a short name of each text; two of one name would only be compared once more
    held = held.select("text_key", "line", F.xxhash64("line").alias("id"), "lead", "numbers", "in_train", "in_eval", n.alias("n"), room.alias("room"), marks.alias("marks"))

    # texts of equal numbers, where both sides have some
    sides = held.groupBy("lead").agg(F.max("in_train").alias("t"), F.max("in_eval").alias("e"), F.count(F.lit(1)).alias("k"))
    met = held.join(sides.where("t AND e AND k > 1").select("lead"), "lead", "left_semi")
    near = _meeting_short(met)
    # of a pair of fewer than SHORT words that is all; the others' longer text has at least so many
    met = cut(met.where(F.floor(n / F.lit(COVERAGE) + 1e-9) >= SHORT).select("lead", "id", "in_train", "in_eval", F.col("n").cast("int").alias("n"), "room", "marks"))
    starts = met.select("lead", "id", "in_train", "in_eval", "n", "room", F.explode("marks").alias("mark"))
    df = starts.groupBy("lead", "mark").agg(F.count(F.lit(1)).alias("df"), F.max("in_train").alias("t"), F.max("in_eval").alias("e"))
    ranked = starts.join(df, ["lead", "mark"])
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("mark", F.lit(64)).cast("int"))
    half = F.pmod(F.shiftright("mark", 6), F.lit(2))
    # a word that one side lacks meets none there, but it takes its place among the rarest
    place = F.struct("df", "mark", (F.col("t") & F.col("e")).alias("both"))
    per_text = ranked.groupBy("lead", "id", "in_train", "in_eval", "n", "room").agg(F.sort_array(F.collect_list(place)).alias("places"), *[F.bit_or(F.when(half == i, bit).otherwise(0)).alias(c) for i, c in enumerate("uv")])
    first = F.explode(F.filter(F.slice("places", F.lit(1), F.col("room") + 1), lambda p: p["both"]))
    by_word = per_text.select("lead", "id", "in_train", "in_eval", "n", "u", "v", first.alias("p")).withColumn("part", F.xxhash64("lead", "p.mark"))

    # texts of many numbers may lack a few of them: those that share numbers in a row
    many = held.where(F.size("numbers") >= MANY - 1)
    runs = F.array_distinct(F.transform(F.sequence(F.lit(1), F.size("numbers") - (RUN - 1)), lambda i: F.xxhash64(F.array_join(F.slice("numbers", i, RUN), " "))))
    flagged = lambda i: F.aggregate("marks", F.lit(0).cast("long"), lambda s, h: s.bitwiseOR(F.when(F.pmod(F.shiftright(h, 6), F.lit(2)) == i, F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(h, F.lit(64)).cast("int"))).otherwise(0)))
    by_run = many.select("id", "in_train", "in_eval", "n", flagged(0).alias("u"), flagged(1).alias("v"), F.explode(runs).alias("part"))

    def meeting(rows: DataFrame) -> DataFrame:
        side = lambda flag, names: rows.where(flag).select("part", *[F.col(c).alias(o) for c, o in zip(("id", "n", "u", "v"), names)])
        lost = F.greatest(F.lit(1), F.floor((1 - COVERAGE) * F.greatest("n", "m") + 1e-9))
        # a word outside of the spans changes at most two bits of the words' signatures
        bits = F.bit_count(F.col("u").bitwiseXOR(F.col("p"))) + F.bit_count(F.col("v").bitwiseXOR(F.col("q")))
        return side("in_train", "xnuv").join(side("in_eval", "ympq"), "part").where((F.greatest("n", "m") >= SHORT) & (F.abs(F.col("n") - F.col("m")) <= lost) & (bits <= 2 * lost)).select("x", "y")

    pairs = meeting(by_word).unionByName(meeting(by_run)).unionByName(near).distinct()
    line = lambda i, key, name: held.select(F.col("id").alias(i), F.col("text_key").alias(key), F.col("line").alias(name))
    both = pairs.join(line("x", "kx", "a"), "x").join(line("y", "ky", "b"), "y").where("kx <> ky")
    return both.select(F.col("kx").alias("x"), F.col("ky").alias("y"), "a", "b").mapInArrow(partial(_judged, short=short), _LINK)


def split_sides(df: DataFrame, key: Column, split: Column) -> DataFrame:
    """(key, in_train, in_eval) of every key that any delivery puts into a split."""
    rows = df.select(key.alias("key"), split_name(split).alias("split")).where(F.col("key").isNotNull() & F.col("split").isNotNull())
    return rows.groupBy("key").agg(F.max(F.col("split") == "train").alias("in_train"), F.max(F.col("split") != "train").alias("in_eval"))


def _pairs_by_value(rows: DataFrame) -> DataFrame:
    """(left_key, right_key) of (key, value, in_train, in_eval) with equal values on both sides."""
    train = rows.where("in_train").select(F.col("key").alias("t"), "value")
    held = rows.where("in_eval").select(F.col("key").alias("e"), "value")
    return train.join(held, "value").where(F.col("t") != F.col("e")).select(F.least("t", "e").alias("left_key"), F.greatest("t", "e").alias("right_key"))


_FIGURE = T.StructType([T.StructField(c, T.StringType()) for c in ("key", "asked", "entity")])


def _figure_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [figure(t) or (None, None) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, pa.string()) for c in (zip(*found) if found else ((), ()))]], names=_FIGURE.names)


def whole_names(figures: DataFrame) -> DataFrame:
    """figures (key, asked, entity) with value, the figure in whole.

    A name of one word stands for the longer name that begins with it, if all longer names that do
    are the same but for a slip; where several firms begin alike it stands for itself.
    """
    led = figures.where(F.col("asked").isNotNull()).withColumn("led", F.substring_index("entity", " ", 1))
    longer = led.where(F.contains("entity", F.lit(" "))).groupBy("led").agg(F.min("entity").alias("least"), F.max("entity").alias("most"))
    single = longer.where(F.levenshtein("least", "most") <= 2).select("led", F.col("least").alias("name"))
    return led.join(single, "led", "left").select("key", F.concat_ws("|", "asked", F.coalesce("name", "entity")).alias("value"))


def same_figure_pairs(examples: DataFrame) -> DataFrame:
    """(left_key, right_key) of examples across splits whose questions ask for the same figure.

    Each question is reduced to its figure (kind, measure, entity, years); two records overlap when
    the reduced texts do in whole. Questions that don't reduce to one overlap when their words are
    the same but for a slip or for words left out. Keys are record_no as strings, the smaller string first.
    Deliveries of one record_no count once, its splits are those of any delivery. Null questions
    and questions without words match nothing.
    """
    sides = split_sides(examples, F.col("record_no").cast("string"), F.col("split"))
    questions = latest_delivery(examples.select("record_no", F.col("question.text").alias("text"), "received_at"), "record_no", ["text"])
    figures = cut(questions.select(F.col("record_no").cast("string").alias("key"), "text").mapInArrow(_figure_batches, _FIGURE))
    reduced = _pairs_by_value(whole_names(figures).join(sides, "key"))
    # what doesn't reduce is compared as it stands
    open_ones = questions.select(F.col("record_no").cast("string").alias("key"), F.array_join(words_of(F.col("text")), " ").alias("line")).where("line <> ''").join(figures.where("asked IS NULL").select("key"), "key", "left_semi").join(sides, "key")
    open_ones = cut(open_ones.withColumn("text_key", F.unhex(F.md5("line"))))
    if open_ones.isEmpty():
        return reduced.distinct()
    texts = open_ones.groupBy("text_key").agg(F.any_value("line").alias("line"), F.max("in_train").alias("in_train"), F.max("in_eval").alias("in_eval"))
    links = text_links(texts, short=1 << 30).unionByName(texts.where("in_train AND in_eval").select(F.col("text_key").alias("x"), F.col("text_key").alias("y")))
    train, held = open_ones.where("in_train").select(F.col("key").alias("t"), F.col("text_key").alias("x")), open_ones.where("in_eval").select(F.col("key").alias("e"), F.col("text_key").alias("y"))
    as_written = links.join(train, "x").join(held, "y").where(F.col("t") != F.col("e")).select(F.least("t", "e").alias("left_key"), F.greatest("t", "e").alias("right_key"))
    return reduced.unionByName(as_written).distinct()


def document_pairs(documents: DataFrame, elements: DataFrame) -> DataFrame:
    """(left_key, right_key) of documents across splits most of whose elements are alike.

    documents: (document_id, metadata with split, ...), elements: (element_id, document_id,
    source_text, ...), deleted or not. More than half of the elements of the longer document must
    have a counterpart in the other with an equal or alike text, counted on both sides. A document
    listed in train and in another split is a pair with itself. Documents without split or elements
    match nothing else. Documents meet over that part of the train document's elements that has the
    fewest possible counterparts, so boilerplate brings none together; all texts are compared only
    of documents that met. A document that holds a third of all elements meets those that may match
    half of it.
    """
    trim = lambda c: F.trim(F.regexp_replace(c, r"^\s+|\s+$", ""))
    sides = split_sides(documents, trim(F.col("document_id")), F.try_element_at(F.col("metadata"), F.lit("split")))
    once = latest_delivery(elements, "element_id", ["document_id", "source_text"])
    placed = once.select(trim(F.col("document_id")).alias("key"), F.array_join(words_of(F.col("source_text")), " ").alias("line")).join(sides, "key")
    numbers = numbers_of(F.col("line"))
    placed = placed.withColumn("line", F.coalesce("line", F.lit(""))).withColumn("text_key", F.unhex(F.md5("line")))
    placed = cut(placed.withColumn("lead", F.xxhash64(F.array_join(numbers, " "))).withColumn("many", F.size(numbers) >= MANY - 1))
    lines = placed.where("line <> ''").select("text_key", "line")

    # a text that nothing on the other side can be like is no counterpart: its numbers must be there
    named = placed.where("line <> ''").groupBy("text_key", "lead", "many").agg(F.max("in_train").alias("in_train"), F.max("in_eval").alias("in_eval"))
    others = named.groupBy("lead").agg(F.count_if("in_train").alias("t"), F.count_if("in_eval").alias("e"))
    hot = named.join(others, "lead").select("text_key", F.when(F.col("many"), F.col("e") + 1).otherwise(F.col("e")).alias("e_hot"), F.when(F.col("many"), F.col("t") + 1).otherwise(F.col("t")).alias("t_hot"), "in_train", "in_eval")
    hot = hot.where("(in_train AND e_hot > 0) OR (in_eval AND t_hot > 0)").drop("in_train", "in_eval")
    sizes = placed.groupBy("key").agg(F.count(F.lit(1)).alias("size"))
    held = placed.where("line <> ''").groupBy("text_key", "key", "in_train", "in_eval").agg(F.count(F.lit(1)).alias("times")).join(hot, "text_key").join(sizes, "key")
    held = cut(held)

    def side(flag: str, heat: str, names: tuple[str, str, str, str]) -> DataFrame:
        """Elements that may have a counterpart, of documents of which more than half may, with what they may lack."""
        rows = held.where(flag).where(F.col(heat) > 0).select(*[F.col(c).alias(o) for c, o in zip(("key", "text_key", "times", "size"), names)], F.floor(4 * F.log2(heat)).cast("int").alias("hot"))
        key, _, times, size = names
        able = rows.groupBy(key).agg(F.sum(times).alias("able"), F.max(size).alias("_s")).where("2 * able > _s").select(key, "able")
        return rows.join(able, key)

    train, other = side("in_train", "e_hot", ("t", "x", "t_times", "t_size")), side("in_eval", "t_hot", ("e", "y", "e_times", "e_size"))

    def linked(xs: DataFrame, ys: DataFrame) -> DataFrame:
        """(x, y) of equal and alike texts among those of xs (x) and ys (y)."""
        sides = xs.select(F.col("x").alias("text_key"), F.lit(True).alias("t"), F.lit(False).alias("e")).unionByName(ys.select(F.col("y").alias("text_key"), F.lit(False).alias("t"), F.lit(True).alias("e")))
        sides = sides.groupBy("text_key").agg(F.max("t").alias("in_train"), F.max("e").alias("in_eval"))
        some = cut(sides.join(lines, "text_key").groupBy("text_key", "in_train", "in_eval").agg(F.any_value("line").alias("line")))
        return cut(text_links(some).unionByName(some.where("in_train AND in_eval").select(F.col("text_key").alias("x"), F.col("text_key").alias("y"))))

    # more than half of the elements have a counterpart, so one of those in the smallest partitions
    # has; elements are taken by degrees of size, of which a document has a few hundred at most
    degrees = train.groupBy("t", "hot").agg(F.sum("t_times").alias("n"), F.max("able").alias("able"), F.max("t_size").alias("t_size"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("t").orderBy("hot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    enough = degrees.withColumn("before", before).where(F.col("before") <= F.col("able") - F.floor(F.col("t_size") / 2) - 1).select("t", "hot")
    chosen = cut(train.join(enough, ["t", "hot"]).select("t", "x", "t_size"))
    met = chosen.join(linked(chosen, other), "x").join(other.select("e", "y", "e_size"), "y")
    met = cut(met.where((F.col("t") != F.col("e")) & (2 * F.least("t_size", "e_size") > F.greatest("t_size", "e_size"))).select("t", "e", F.greatest("t_size", "e_size").alias("longer")).distinct())
    # of documents that met all texts are compared
    train = cut(train.select("t", "x", "t_times").join(met.select("t").distinct(), "t", "left_semi"))
    other = cut(other.select("e", "y", "e_times").join(met.select("e").distinct(), "e", "left_semi"))
    links = linked(train, other)

    def most(pairs: DataFrame, mine: DataFrame, theirs: DataFrame, names: tuple[str, str, str, str, str]) -> DataFrame:
        """The pairs of which one document has most of its elements' counterparts in the other.

        What each document is alike to is listed first, once for all its pairs, so that rows grow
        with a pair's elements and not with the texts that each of them is alike to.
        """
        key, text, times, other_key, other_text = names
        alike_to = theirs.join(links, other_text).select(other_key, text).distinct()
        counts = pairs.join(mine, key).join(alike_to, [other_key, text]).groupBy("t", "e", "longer").agg(F.sum(times).alias("n"))
        return cut(counts.where("2 * n > longer").drop("n"))

    both = most(most(met, train, other, ("t", "x", "t_times", "e", "y")), other, train, ("e", "y", "e_times", "t", "x"))
    pairs = both.select(F.least("t", "e").alias("left_key"), F.greatest("t", "e").alias("right_key"))
    own = sides.where("in_train AND in_eval").select(F.col("key").alias("left_key"), F.col("key").alias("right_key"))
    return pairs.unionByName(own).distinct()


def overlap_report(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """Records and overlapping records per table, source and split.

    pairs: (table_name, left_key, right_key); members: (table_name, key, source, split), one row
    for each split a record is listed in. Null sources and splits are groups of their own.
    """
    hit = pairs.select("table_name", F.explode(F.array("left_key", "right_key")).alias("key")).distinct().withColumn("hit", F.lit(1))
    rows = members.distinct().join(hit, ["table_name", "key"], "left")
    return rows.groupBy("table_name", "source", "split").agg(F.count(F.lit(1)).alias("n_records"), F.count("hit").alias("n_overlapping"))
