"""Operator 3: fuzzy line deduplication by SimHash, in DataFrame functions only.

Lines are lower-cased, trimmed and single-spaced; empty ones take no part. A line's SimHash has a bit set if it is set
in over half of the 64-bit hashes of its different words, in which all digits count as zero. Two different lines are
linked if their SimHashes differ in at most ``BITS`` bits and their edit similarity, 1 - distance / longer length, is
``SIMILARITY`` or more. With ``BITS`` = 3 the differing bits lie in at most three of five blocks, so two blocks agree:
the ten pairs of blocks are the join keys.

Lines of a group are not paired with each other. First every line is compared with the most frequent line of its
SimHash, and every SimHash with the most frequent one of each of its keys; what these links connect is one group. Then
only pairs whose ends lie in different groups are compared, so in the end the groups are those of all links. Keys of
many SimHashes and SimHashes of many lines are dealt to tasks by pairs of blocks. Of every group the first occurrence
by document id and position stays (null ids last).

A null text counts as empty and stays null; of rows of equal id and text one holds the first occurrences and all
lines of the others are repeats; a line of any length is hashed whole; extra columns are carried along whatever their
names; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from litmill.llm.common import BROADCAST_KEYS, Scratch, components, keys_to_join, row_key, unused

BITS, SIMILARITY = 3, 0.8
BLOCKS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
#: Members of a group that one task compares with as many others.
BLOCK = 2048
#: SimHashes of a key that are compared with their neighbours at once, on either side.
BESIDE = 32
#: Length up to which two lines are compared as they are.
SHORT = 60
#: White space that is not a line end.
SPACE = r" \t\r\x0B\x0C"
#: Words of a line whose bits are counted in 16-bit counters.
COUNTED = (1 << 15) - 1


def normalised(text: Column) -> Column:
    """Lower case and with single spaces; what stands at the ends of lines is trimmed with the lines."""
    low = F.lower(text)
    other = reduce(lambda a, b: a | b, [text.contains(x) for x in ("  ", "\t", "\r", "\x0b", "\x0c")])
    return F.when(other, F.regexp_replace(low, f"[{SPACE}]+", " ")).otherwise(low)


def _let(value: Column, use) -> Column:
    """``use`` of a value that is computed once."""
    return F.transform(F.array(value), use)[0]


def _words(line: Column, digits: Column) -> Column:
    """The different words of a line; ``digits`` is false if it has none."""
    return F.array_distinct(F.split(F.when(digits & line.rlike("[1-9]"), F.translate(line, "123456789", "000000000")).otherwise(line), " "))


def _lanes(width: int) -> Column:
    return F.lit(sum(1 << at for at in range(0, 64, width)))


def _added(word: Column, width: int) -> list[Column]:
    """What a word's hash adds to ``width`` longs, each of which holds a counter for every ``width``-th bit."""
    return [F.shiftrightunsigned(word, n).bitwiseAND(_lanes(width)) for n in range(width)]


def _majority(counters: list[Column], words: Column) -> Column:
    """The bits counted for over half of the words, of which there are fewer than 2 ** (width - 1). What is added to a
    counter carries into its highest bit but one then, so no sign changes."""
    width = len(counters)
    more = _lanes(width) * (F.lit((1 << (width - 2)) - 1).cast("long") - F.shiftright(words.cast("long"), 1))
    each = [F.shiftleft(F.shiftrightunsigned(c + more, width - 2).bitwiseAND(_lanes(width)), n) for n, c in enumerate(counters)]
    return reduce(lambda a, b: a.bitwiseOR(b), each)


def _long_simhash(line: Column) -> Column:
    """The SimHash of a line of any length, in one expression."""
    names = [f"c{n}" for n in range(32)]
    hashes = F.transform(_words(line, F.lit(True)), lambda w: F.xxhash64(w))
    zero = F.struct(*[F.lit(0).cast("long").alias(c) for c in names])
    add = lambda s, w: F.struct(*[(s[c] + x).alias(c) for c, x in zip(names, _added(w, 32), strict=True)])
    return _let(hashes, lambda h: F.aggregate(h, zero, add, lambda s: _majority([s[c] for c in names], F.size(h))))


def _lines(docs: DataFrame, id_column: str, text_column: str, only: DataFrame | None = None) -> DataFrame:
    """Rows (doc, id, digits: whether there are any in the text, pos, line) of the lines that take part, and of the first
    line of every document, which may be empty; of the documents in ``only`` (doc) where it is given."""
    rows = docs.select(row_key(id_column, text_column).alias("doc"), F.col(id_column).alias("id"), F.coalesce(text_column, F.lit("")).alias("text"))
    if only is not None:
        rows = rows.join(keys_to_join(only), "doc", "left_semi")
    rows = rows.withColumn("digits", F.col("text").rlike("[1-9]"))
    split = rows.select("doc", "id", "digits", F.posexplode(F.split(normalised(F.col("text")), "\n")).alias("pos", "raw"))
    return split.select("doc", "id", "digits", "pos", F.trim("raw").alias("line")).filter("line <> '' OR pos = 0")


def hashed_lines(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Rows (doc, id, pos, h: a hash of the line, size: its length, fp: its SimHash) of ``_lines``, each as often as
    it occurs: ``row`` tells equal documents apart while the bits of their words are counted, and no longer."""
    keys = ["row", "doc", "id", "pos", "h", "size"]
    line, long = F.col("line"), F.col("size") > 2 * COUNTED  # else it has no more words than can be counted
    hashed = _lines(docs, id_column, text_column).withColumn("row", F.monotonically_increasing_id()).withColumn("h", F.xxhash64("line")).withColumn("size", F.length("line"))
    words = F.when(long, F.array(_long_simhash(line).cast("string"))).otherwise(_words(line, F.col("digits")))
    each = hashed.select(*keys, F.explode(words).alias("word")).select(*keys, F.when(long, F.col("word").cast("long")).otherwise(F.xxhash64("word")).alias("w"))
    counters = [f"c{n}" for n in range(16)]
    counted = each.groupBy(*keys).agg(*[F.sum(x).alias(c) for c, x in zip(counters, _added(F.col("w"), 16), strict=True)], F.count(F.lit(1)).alias("n"))
    return counted.select(*keys[1:], _majority([F.col(c) for c in counters], F.col("n")).alias("fp"))


def different_lines(occurrences: DataFrame) -> DataFrame:
    """Rows (h, fp, size, n: occurrences, at: order, document and position of the first) of different lines that aren't
    empty."""
    occurrences = occurrences.filter("size > 0")
    integral = occurrences.schema["id"].dataType.typeName() in ("byte", "short", "integer", "long")
    number = F.col("id").cast("decimal(20,0)") * F.lit("4294967296").cast("decimal(10,0)") + F.col("pos").cast("decimal(10,0)")
    last = F.lit("1" + 31 * "0").cast("decimal(32,0)") + F.col("pos").cast("decimal(10,0)")
    order = F.coalesce(number, last) if integral else F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.col("pos").alias("pos"))
    rows = occurrences.select("h", "fp", "size", "doc", "pos", order.alias("order"))
    first = [F.min("order").alias("order"), *[F.min_by(c, "order").alias(c) for c in ("doc", "pos")]]
    lines = rows.groupBy("h").agg(F.min("fp").alias("fp"), F.min("size").alias("size"), F.count(F.lit(1)).alias("n"), *first)
    return lines.select("h", "fp", "size", "n", F.struct("order", "doc", "pos").alias("at"))


def _keys(fp: Column) -> Column:
    """The ten join keys of a SimHash."""
    block = lambda at, bits: F.shiftrightunsigned(fp, at).bitwiseAND(F.lit((1 << bits) - 1))
    pairs = enumerate(combinations(range(len(BLOCKS)), 2))
    return F.array(*[F.lit(n << 26).cast("long") + F.shiftleft(block(*BLOCKS[i]), 13) + block(*BLOCKS[j]) for n, (i, j) in pairs])


def _near(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b)) <= BITS


def _long_enough(a: Column, b: Column) -> Column:
    """Whether two lengths allow the similarity."""
    return F.least(a, b) >= F.greatest(a, b) * SIMILARITY


def shared_keys(scratch: Scratch, fps: DataFrame) -> DataFrame:
    """Rows (key, fp, h, hub, hub_h) of the SimHashes (fp, n, h) that may be near others of a key, with the lines that
    lead them; the hub of a key is its most frequent SimHash. In a key of few SimHashes it is known which are near others."""
    of_key = Window.partitionBy("key")
    order = of_key.orderBy("fp")
    keyed = fps.select(F.explode(_keys(F.col("fp"))).alias("key"), "fp")
    shared = keyed.withColumn("one", F.lag("fp").over(order)).withColumn("two", F.lead("fp").over(order)).filter("one IS NOT NULL OR two IS NOT NULL")
    beside = F.collect_list("fp").over(order.rowsBetween(-BESIDE, BESIDE))
    marked = shared.select("key", "fp", F.count(F.lit(1)).over(of_key).alias("many"), beside.alias("beside"))
    near = F.exists("beside", lambda x: (x != F.col("fp")) & _near(x, F.col("fp")))
    found = scratch.write(marked.filter((F.col("many") > BESIDE + 1) | near).select("key", "fp"))
    leads = fps.join(keys_to_join(found.select("fp").distinct()), "fp", "left_semi").select("fp", "n", "h")
    led = scratch.write(found.join(leads, "fp"))
    hubs = led.groupBy("key").agg(F.max(F.struct("n", "fp", "h")).alias("hub"))
    return led.join(hubs, "key").select("key", "fp", "h", F.col("hub.fp").alias("hub"), F.col("hub.h").alias("hub_h"))


def star_pairs(lines: DataFrame, fps: DataFrame, shared: DataFrame) -> DataFrame:
    """Pairs (a, b) of each line and its SimHash's lead, and of each SimHash's lead and those of its keys' hubs."""
    several = fps.filter("lines > 1").select("fp", F.col("h").alias("lead"))
    within = lines.join(keys_to_join(several, BROADCAST_KEYS // 2), "fp").filter("h <> lead").select(F.col("h").alias("a"), F.col("lead").alias("b"))
    beyond = shared.filter((F.col("fp") != F.col("hub")) & _near(F.col("fp"), F.col("hub"))).select(F.col("h").alias("a"), F.col("hub_h").alias("b"))
    return within.union(beyond.distinct())


def _dealt(rows: DataFrame, group: str, node: str, n: str) -> DataFrame:
    """``rows`` with (task, side): a group of ``n`` rows is dealt by blocks, and every pair of blocks is one task in
    which only rows of different sides count; within a block all do (side null)."""
    blocks = F.ceil(F.col(n) / F.lit(BLOCK)).cast("int")
    rows = rows.withColumn("block", F.pmod(F.xxhash64(node), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    task = F.xxhash64(group, F.least("block", "other"), F.greatest("block", "other"))
    return rows.withColumn("task", task).withColumn("side", F.when(F.col("block") != F.col("other"), F.col("block") > F.col("other"))).drop("block", "other")


def cross_pairs(scratch: Scratch, lines: DataFrame, shared: DataFrame) -> DataFrame:
    """Pairs (a, b) of lines (h, fp, size, root) with near SimHashes, long enough and of different roots."""
    state = scratch.write(lines.groupBy("fp").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count(F.lit(1)).alias("n")))
    known = shared.select("key", "fp").join(state, "fp")
    mixed = known.groupBy("key").agg(F.min("low").alias("least"), F.max("high").alias("most"), F.count(F.lit(1)).alias("many")).filter("least < most").select("key", "many")
    known = _dealt(known.join(mixed, "key"), "key", "fp", "many")
    side = lambda x: known.select("task", F.col("side").alias(f"s{x}"), *[F.col(c).alias(f"{c}_{x}") for c in ("fp", "low", "high", "n")])
    one = (F.col("low_a") == F.col("high_b")) & (F.col("high_a") == F.col("low_b"))  # then all are equal
    apart = F.when(F.col("sa").isNull(), F.col("fp_a") < F.col("fp_b")).otherwise(~F.col("sa") & F.col("sb"))
    found = side("a").join(side("b"), "task").filter(apart & _near(F.col("fp_a"), F.col("fp_b")) & ~one).select("fp_a", "n_a", "fp_b", "n_b").distinct()
    own = state.filter("low < high").select(F.col("fp").alias("fp_a"), F.col("n").alias("n_a"), F.col("fp").alias("fp_b"), F.col("n").alias("n_b"))
    pairs = scratch.write(found.union(own))
    if pairs.isEmpty():
        return pairs.select(F.col("fp_a").alias("a"), F.col("fp_b").alias("b"))
    parts = lambda n: F.sequence(F.lit(0), F.ceil(F.col(n) / F.lit(BLOCK)).cast("int") - 1)
    parted = pairs.withColumn("part_a", F.explode(parts("n_a"))).withColumn("part_b", F.explode(parts("n_b")))
    placed = lines.join(state.select("fp", "n"), "fp").withColumn("part", F.pmod(F.xxhash64("h"), F.ceil(F.col("n") / F.lit(BLOCK))).cast("int"))
    end = lambda x: placed.select(F.col("fp").alias(f"fp_{x}"), F.col("part").alias(f"part_{x}"), *[F.col(c).alias(f"{c}_{x}") for c in ("h", "size", "root")])
    left = parted.join(end("a"), ["fp_a", "part_a"])
    wanted = (F.col("root_a") != F.col("root_b")) & _long_enough(F.col("size_a"), F.col("size_b")) & ((F.col("fp_a") != F.col("fp_b")) | (F.col("h_a") < F.col("h_b")))
    return left.join(end("b"), ["fp_b", "part_b"]).filter(wanted).select(F.col("h_a").alias("a"), F.col("h_b").alias("b"))


def similar(a: Column, b: Column) -> Column:
    """Whether the edit similarity of two different texts is high enough.

    The distance of short texts is computed within its bound. What both begin and end with, in whole words, adds no
    distance and is cut off from longer ones. If as many words are left of both, the distances word by word add up to
    no less than the distance; only where that is too much the distance itself is computed."""
    def cut(x: Column, y: Column) -> Column:
        same = lambda p, q: F.array_position(F.zip_with(p, q, lambda v, w: v.eqNullSafe(w)), F.lit(False)) - 1
        front = same(x, y)
        back = F.least(same(F.reverse(x), F.reverse(y)), F.least(F.size(x), F.size(y)) - front)
        part = lambda z: F.slice(z, (front + 1).cast("int"), F.greatest(F.size(z) - front - back, F.lit(0)).cast("int"))
        return F.struct(part(x).alias("x"), part(y).alias("y"))

    bound = F.floor(F.greatest(F.length(a), F.length(b)) * (1 - SIMILARITY) + 1e-9).cast("int")
    left = lambda: cut(F.split(a, " "), F.split(b, " "))
    joined = lambda z: F.array_join(F.transform(z, lambda w: F.concat(w, F.lit(" "))), "")

    def judged(m: Column) -> Column:
        by_word = F.aggregate(F.zip_with(m.x, m.y, lambda v, w: F.levenshtein(v, w)), F.lit(0), lambda total, d: total + d)
        whole = F.call_function("levenshtein", joined(m.x), joined(m.y), bound) >= 0
        return F.when((F.size(m.x) == F.size(m.y)) & (by_word <= bound), True).otherwise(whole)

    within = lambda x, y: F.call_function("levenshtein", x, y, bound) >= 0
    return F.when(~_long_enough(F.length(a), F.length(b)), False).when(F.greatest(F.length(a), F.length(b)) <= SHORT, within(a, b)).otherwise(_let(left(), judged))


def texts_of(scratch: Scratch, docs: DataFrame, lines: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """Rows (h, line) of the lines (h, at), read from the documents that hold their first occurrences."""
    wanted = scratch.write(lines.select("h", "at.doc"))
    found = _lines(docs, id_column, text_column, wanted.select("doc").distinct()).select(F.xxhash64("line").alias("h"), "line")
    return scratch.write(found.join(keys_to_join(wanted.select("h")), "h", "left_semi").groupBy("h").agg(F.first("line").alias("line")))


def verified(scratch: Scratch, texts: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) whose ``texts`` (h, line) are similar."""
    end = lambda h, line: texts.select(F.col("h").alias(h), F.col("line").alias(line))
    linked = scratch.write(pairs).join(end("a", "x"), "a").join(end("b", "y"), "b")
    return scratch.write(linked.filter(similar(F.col("x"), F.col("y"))).select("a", "b"))


def firsts_of(scratch: Scratch, docs: DataFrame, occurrences: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Rows (doc, pos): the occurrence of every group of lines that stays."""
    lines = scratch.write(different_lines(occurrences))
    fps = scratch.write(lines.groupBy("fp").agg(F.max("n").alias("n"), F.max_by("h", "n").alias("h"), F.count(F.lit(1)).alias("lines")))
    shared = scratch.write(shared_keys(scratch, fps))
    wanted = scratch.write(shared.select("fp").union(fps.filter("lines > 1").select("fp")).distinct())
    candidates = scratch.write(lines.join(keys_to_join(wanted), "fp", "left_semi"))
    texts = texts_of(scratch, docs, candidates, id_column, text_column)
    stars = verified(scratch, texts, star_pairs(candidates, fps, shared))
    roots = scratch.write(components(scratch, stars))
    named = candidates.join(keys_to_join(roots, BROADCAST_KEYS // 2), F.col("h") == F.col("node"), "left").select("h", "fp", "size", F.coalesce("root", "h").alias("root"))
    crossing = scratch.write(cross_pairs(scratch, scratch.write(named), shared))
    if not crossing.isEmpty():
        roots = scratch.write(components(scratch, verified(scratch, texts, crossing).union(roots.select("node", "root"))))
    linked = lines.select("h", "at").join(keys_to_join(roots, BROADCAST_KEYS // 2), F.col("h") == F.col("node"), "left")
    firsts = linked.filter("root IS NOT NULL").groupBy("root").agg(F.min("at").alias("at"))
    return scratch.write(linked.filter("root IS NULL").select("at.doc", "at.pos").union(firsts.select("at.doc", "at.pos")))


def kept_lines(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Rows (doc, pos): the occurrence of every group that stays; ``doc`` is the ``row_key`` of the document."""
    scratch = Scratch(docs.sparkSession, "lines")
    kept = firsts_of(scratch, docs, hashed_lines(docs, id_column, text_column), id_column, text_column)
    scratch.keep_only(kept)
    return kept


def dedup_lines(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of ``docs`` without the lines that repeat one before, other columns as they are."""
    key, places, first, row = (unused(docs, c) for c in ("doc_key", "kept_places", "first_row", "row_number"))
    scratch = Scratch(docs.sparkSession, "dedup-lines")
    kept = kept_lines(docs, id_column, text_column).groupBy("doc").agg(F.collect_list("pos").alias(places)).withColumnRenamed("doc", key)
    keyed = docs.withColumn(key, row_key(id_column, text_column))
    again = scratch.write(keyed.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(key))
    single = keyed.join(keys_to_join(again), key, "left_anti").withColumn(first, F.lit(True))
    several = scratch.write(keyed.join(keys_to_join(again), key, "left_semi").withColumn(row, F.monotonically_increasing_id()))
    least = several.groupBy(key).agg(F.min(row).alias(first))
    several = several.join(keys_to_join(least, BROADCAST_KEYS // 2), key).withColumn(first, F.col(first) == F.col(row)).drop(row)
    rows = single.unionByName(several).join(kept, key, "left")
    blank = lambda line: ~line.rlike(f"[^{SPACE}]")
    stays = lambda line, at: F.coalesce(F.col(first) & F.array_contains(places, at), F.lit(False)) | blank(line)
    text = F.array_join(F.filter(F.split(F.col(text_column), "\n"), stays), "\n")
    return rows.select(*[text.alias(c) if c == text_column else F.col(c) for c in docs.columns])


def line_report(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row: id, n_lines (that take part), n_kept, n_dropped."""
    scratch = Scratch(docs.sparkSession, "lines")
    occurrences = scratch.write(hashed_lines(docs, id_column, text_column))
    kept = firsts_of(scratch, docs, occurrences, id_column, text_column)
    counted = scratch.write(occurrences.groupBy("doc", "id").agg(F.count_if(F.col("size") > 0).alias("all"), F.count_if(F.col("pos") == 0).alias("copies")))
    scratch.keep_only(kept, counted)
    of_doc = kept.groupBy("doc").agg(F.count(F.lit(1)).alias("kept"))
    rows = counted.join(of_doc, "doc", "left").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    n_lines = (F.col("all") / F.col("copies")).cast("long")  # every row has a first line
    n_kept = F.when(F.col("copy") == 1, F.coalesce("kept", F.lit(0))).otherwise(0).cast("long")
    return rows.select(F.col("id").alias(id_column), n_lines.alias("n_lines"), n_kept.alias("n_kept"), (n_lines - n_kept).alias("n_dropped"))
