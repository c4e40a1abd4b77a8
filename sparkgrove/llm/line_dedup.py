"""Line dedup by a segment-partition edit join, with DataFrame functions only.

Two lines are linked if their edit distance is at most ``threshold``. A line is split into threshold + 1 segments of near-equal
length; a line within the threshold has one of them unchanged, at most so far from its place as the rule of multi-match
aware selection says. So each line puts its segments into an index by (length, number, segment) and probes it with its
substrings for lengths from its own down to threshold less. Lines that share a key get counts of ``SYMBOLS``; as an edit
changes two counts by one at most, most false matches fall within the join. What is left is verified once a pair with a banded
bit-parallel edit distance, between what their equal beginnings and ends leave.

1. Equal lines are collapsed first: only distinct lines, as hashes with their keys, are shuffled and indexed.
2. Entries of one key meet in one task, but for keys whose bucket holds far more than its share (a table of 2^18 buckets
   counts all entries): these are dealt out in salted parts.
3. Of a key that few lines share all pairs are taken. Of one that many share, its line with most copies is paired with all
   others first; then what isn't connected with the key's largest component is tried against some of its members, and at
   last against every line of another component, by keys made of the rest of the line. So no link between components is
   lost, but a large group of near copies doesn't make all its pairs.

Classes of lines are the connected components of links. Of each class the first line stays, by (doc_id, line number); the
others go. Lines of blanks only take no part and always stay; lines under ``least_chars`` have exact repeats only.

Only hashes, segments' hashes and counts are shuffled, and the texts of lines that share a key. Whole texts are if there
are more changed documents than ``BROADCAST_ROWS``; up to that number the list of dropped lines goes to all executors.

Defined results: a null text has no lines and stays null; lines are what stands between line feeds; documents of equal ids
and texts get equal results, those of equal ids and other texts go by a hash of the text; a null doc_id comes first; no
rows give no rows. ``dedup_lines`` keeps all other columns, ``line_report`` none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from sparkgrove.llm.common import id_text, limited, stored, stored_small
from sparkgrove.llm.graph import components

THRESHOLD = 2
BROADCAST_ROWS = 500_000
#: Line numbers in the list of dropped lines, when it is sent to all executors.
BROADCAST_NUMBERS = 8_000_000
#: Symbols that are counted modulo 64, ten to a long.
SYMBOLS = ["entaiorshd", "lucmpgfbyw", "vkxjqz .,-"]
COUNTS = [f"counts{k}" for k in range(len(SYMBOLS))]
BUCKETS = 1 << 18
#: A bucket with more entries than this, and than four times the mean, has its keys dealt out in parts.
PART_ROWS = 4096
#: Up to so many entries of one key are paired with each other at once.
FEW = 16
#: Members of a component against which others are tried before all are.
TRIED = 4
BLANKS = " \t\r\v\f"


def split_lines(docs: DataFrame) -> DataFrame:
    """key (of the document's id), mark (of its text), no (from 0) and line, of lines that aren't blank."""
    keyed = docs.select(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("key"), F.xxhash64("text").alias("mark"), "text")
    lines = keyed.select("key", "mark", F.posexplode(F.split("text", "\n")).alias("no", "line"))
    return lines.where(F.btrim("line", F.lit(BLANKS)) != "")


def line_id(line: Column) -> Column:
    return F.xxhash64(line)


def line_check(line: Column) -> Column:
    """A second hash, which tells lines of equal ids apart where they are known by hashes only."""
    return F.crc32(F.encode(line, "UTF-8"))


def symbol_counts(line: Column, symbols: str) -> Column:
    """How often each of the symbols stands in the line, modulo 64, packed into a long."""
    packed = F.lit(0).cast("long")
    for k, c in enumerate(symbols):
        n = F.octet_length(line) - F.octet_length(F.replace(line, F.lit(c), F.lit("")))
        packed = packed + F.shiftleft(n.bitwiseAND(F.lit(63)).cast("long"), 6 * k)
    return packed


def symbols_apart(x: str, y: str) -> Column:
    """At least so much do the counts of x and y differ."""
    total = F.lit(0).cast("long")
    for c, symbols in zip(COUNTS, SYMBOLS, strict=True):
        for k in range(len(symbols)):
            d = F.abs(F.shiftright(F.col(f"{x}.{c}"), 6 * k).bitwiseAND(63) - F.shiftright(F.col(f"{y}.{c}"), 6 * k).bitwiseAND(63))
            total = total + F.least(d, 64 - d)
    return total


def rules_of(threshold: int) -> list[tuple[int, int, int]]:
    """(shorter, part, shift): of a line that is ``shorter``, segment ``part`` is looked for moved by ``shift``.

    The first threshold + 1 are the line's own segments, which stand in the index; the others are probes.
    """
    rules = [(0, part, 0) for part in range(threshold + 1)]
    for shorter in range(threshold + 1):
        for part in range(threshold + 1):
            low = max(-part, shorter - (threshold - part))
            high = min(part, shorter + (threshold - part))
            rules += [(shorter, part, shift) for shift in range(low, high + 1) if shorter or shift]
    return rules


def _begin(length: Column, part, parts: int) -> Column:
    """Where segment ``part`` of a line of this length begins; segments differ by one character at most."""
    return F.floor(length * part / parts).cast("int")


def wide(line: Column) -> Column:
    """The line with four bytes for each character, of which any stretch is found without going through those before it."""
    return F.encode(line, "UTF-32")


def line_keys(line: Column, length: Column, threshold: int, only: Column | None = None) -> Column:
    """For each rule a hash of (length, number, substring): the line's index entries and then its probes. line: wide().

    only: the rules' shorter, where others aren't wanted.
    """
    parts, of = threshold + 1, {}
    for shorter, part, shift in rules_of(threshold):
        other = length - shorter
        begin = _begin(other, part, parts)
        key = F.xxhash64(other, F.lit(part), F.substring(line, (begin + shift) * 4 + 1, (_begin(other, part + 1, parts) - begin) * 4))
        of.setdefault(shorter, []).append(key)
    if only is None:
        return F.array(*(key for keys in of.values() for key in keys))
    return F.coalesce(*(F.when(only == shorter, F.array(*keys)) for shorter, keys in of.items()))


def _named(value: Column, then) -> Column:
    """then(value), with the value worked out once even if it is used in a function of elements."""
    return F.element_at(F.transform(F.array(value), then), 1)


def edit_distance(a: Column, b: Column, threshold: int) -> Column:
    """The edit distance of two strings where it is at most threshold, else more than threshold.

    a and b are arrays of characters whose sizes differ by threshold at most, neither empty. Column i of the matrix is a
    vector of 2 * threshold + 1 bits around the diagonal (Hyyro's banded form of Myers' algorithm); bit k is row
    i - threshold + k. The distance is followed down the band's last row and then along the matrix's last row.
    """
    width = 2 * threshold + 1
    full, top = (1 << width) - 1, width - 1

    def bit(x: Column, k: Column) -> Column:
        return F.call_function("shiftright", x, k).bitwiseAND(F.lit(1))

    def flip(x: Column) -> Column:
        return x.bitwiseXOR(F.lit(full))

    def state(vp: Column, vn: Column, d: Column) -> Column:
        return F.struct(vp.cast("int").alias("vp"), vn.cast("int").alias("vn"), d.cast("int").alias("d"))

    def step(s: Column, i: Column) -> Column:
        vp, vn = s["vp"], s["vn"]

        def with_equal(eq: Column) -> Column:
            d0 = (eq.bitwiseAND(vp) + vp).bitwiseXOR(vp).bitwiseOR(eq).bitwiseOR(vn).bitwiseAND(F.lit(full))
            return _named(d0, with_diagonal)

        def with_diagonal(d0: Column) -> Column:
            hp, hn = vn.bitwiseOR(flip(d0.bitwiseOR(vp))), d0.bitwiseAND(vp)
            row = F.size(a) - 1 - i + threshold
            more = F.when(row >= top, 1 - bit(d0, F.lit(top))).otherwise(bit(hp, row) - bit(hn, row))
            right = F.shiftright(d0, 1)
            return state(hn.bitwiseOR(flip(right.bitwiseOR(hp))), right.bitwiseAND(hp), s["d"] + more)

        def equal(own: Column) -> Column:
            eq = F.lit(0)
            for k in range(width):  # get() is null outside of the array
                eq = eq + F.when(F.get(a, i + (k - threshold)) == own, 1 << k).otherwise(0)
            return eq

        # d falls along the matrix's last row only, by its 2 * threshold columns within the band at most
        return F.when(s["d"] > 3 * threshold, s).otherwise(_named(_named(F.get(b, i), equal), with_equal))

    start = state(F.lit(full - (1 << threshold) + 1), F.lit(0), F.least(F.lit(threshold), F.size(a)))
    return F.aggregate(F.sequence(F.lit(0), F.size(b) - 1), start, step)["d"]


def characters(line: Column) -> Column:
    return F.regexp_extract_all(line, F.lit("(?s)."), F.lit(0))


#: Powers of two that add up to the length of equal beginnings or ends; longer ones are only cut in part.
STEPS = [1 << k for k in range(13, -1, -1)]


def without_ends(x: Column, y: Column) -> Column:
    """x and y without their equal beginnings and then ends, which leave the distance as it is."""

    def cut(both: Column, part, rest) -> Column:
        x, y = both["x"], both["y"]

        def longer(n: Column, step: Column) -> Column:
            fits = (n + step <= F.least(F.char_length(x), F.char_length(y))) & (part(x, n + step) == part(y, n + step))
            return F.when(fits, n + step).otherwise(n)

        equal = F.aggregate(F.array(*map(F.lit, STEPS)), F.lit(0), longer)
        return _named(equal, lambda n: F.struct(rest(x, n).alias("x"), rest(y, n).alias("y")))

    begun = _named(F.struct(x.alias("x"), y.alias("y")), lambda b: cut(b, lambda s, n: F.substring(s, F.lit(1), n), lambda s, n: F.substring(s, n + 1, F.char_length(s))))
    return _named(begun, lambda b: cut(b, lambda s, n: F.substring(s, -n, n), lambda s, n: F.substring(s, F.lit(1), F.char_length(s) - n)))


def line_distance(x: Column, y: Column, threshold: int) -> Column:
    """The edit distance of two lines where it is at most threshold, else more than threshold (or null)."""

    def of(rest: Column) -> Column:
        sizes = F.char_length(rest["x"]), F.char_length(rest["y"])
        chars = F.struct(characters(rest["x"]).alias("x"), characters(rest["y"]).alias("y"))
        return F.when(F.least(*sizes) == 0, F.greatest(*sizes)).otherwise(_named(chars, lambda c: edit_distance(c["x"], c["y"], threshold)))

    return F.when(F.abs(F.char_length(x) - F.char_length(y)) <= threshold, _named(without_ends(x, y), of))


def verified(pairs: DataFrame, texts: DataFrame, threshold: int) -> DataFrame:
    """Those of the distinct pairs (a, b) of line ids that are within the threshold, as a table. texts: id, line."""
    both = pairs.join(texts.select(F.col("id").alias("a"), F.col("line").alias("x")), "a").join(texts.select(F.col("id").alias("b"), F.col("line").alias("y")), "b")
    return stored_small(both.where(line_distance(F.col("x"), F.col("y"), threshold) <= threshold).select("a", "b").distinct())


def distinct_lines(docs: DataFrame, threshold: int, least_chars: int) -> DataFrame:
    """id, check, keys and n (occurrences) of each distinct line; keys is empty for lines under least_chars.

    The lines themselves aren't shuffled. The array function, which isn't compiled into one method with what stands around it,
    lets this projection be compiled in parts: as a single method it would be too large for the JVM to optimize.
    """
    lines = split_lines(docs).select("line", wide(F.col("line")).alias("wide"))
    length = (F.octet_length("wide") / 4).cast("int")
    keys = F.when(length >= least_chars, line_keys(F.col("wide"), length, threshold)).otherwise(F.array().cast("array<long>"))
    known = F.element_at(F.transform(F.array(line_id(F.col("line"))), lambda x: x), 1)
    hashed = lines.select(known.alias("id"), line_check(F.col("line")).alias("check"), keys.alias("keys"))
    return hashed.groupBy("id", "check", "keys").agg(F.count("*").alias("n"))


def shared_keys(distinct: DataFrame, threshold: int) -> DataFrame:
    """key, id, rule of entries that have another one with their key, and whether many have it (hot)."""
    entries = distinct.select("id", F.posexplode("keys").alias("rule", "key"))
    bucket = F.pmod(F.col("key"), F.lit(BUCKETS))
    counts = stored_small(entries.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("entries")))
    most = max(PART_ROWS, 4 * (counts.agg(F.sum("entries")).first()[0] or 0) // BUCKETS)
    heavy = F.broadcast(counts.where(F.col("entries") > most).select(F.col("bucket").alias("_bucket"), F.ceil(F.col("entries") / most).alias("parts")))
    dealt = entries.join(heavy, bucket == F.col("_bucket"), "left").select("key", "id", F.col("rule").cast("byte").alias("rule"), F.coalesce(F.pmod(F.col("id"), "parts").cast("int"), F.lit(-1)).alias("part")).repartition("key", "part")
    own = W.Window.partitionBy("key", "part")
    grouped = dealt.withColumn("n", F.count("*").over(own)).withColumn("n_own", F.count_if(F.col("rule") <= threshold).over(own))
    return grouped.where((F.col("part") >= 0) | (F.col("n") > 1) & (F.col("n_own") > 0)).select("key", "id", "rule", ((F.col("part") >= 0) | (F.col("n") > FEW)).alias("hot"))


def may_be_near(x: str, y: str, threshold: int) -> Column:
    """Whether entries x and y of one key, at least one of them of the index, may be of lines within the threshold."""
    return (F.least(f"{x}.rule", f"{y}.rule") <= threshold) & (symbols_apart(x, y) <= 2 * threshold)


def _ends(x: str, y: str) -> list[Column]:
    return [F.least(f"{x}.id", f"{y}.id").alias("a"), F.greatest(f"{x}.id", f"{y}.id").alias("b")]


def _apart(hot: DataFrame, found: DataFrame) -> DataFrame:
    """Entries, with component and the key's largest one, of keys with lines of more than one component. found: components()."""
    known = stored(hot.join(limited(found, BROADCAST_ROWS), F.col("id") == F.col("node"), "left").select(*ENTRY, F.coalesce("component", "id").alias("component")))
    sizes = known.groupBy("key", "component").agg(F.count("*").alias("k"))
    largest = sizes.groupBy("key").agg(F.max(F.struct("k", F.col("component"))).alias("most"), F.count("*").alias("n")).where("n > 1").select("key", F.col("most.component").alias("largest"))
    return stored(known.join(limited(stored_small(largest), BROADCAST_ROWS), "key"))


ENTRY = ["key", "id", "rule", *COUNTS]


def _finer(entries: DataFrame, texts: DataFrame, threshold: int) -> DataFrame:
    """Entries whose keys also have a segment of what the key's own segment leaves of the line, which is within the threshold too.

    The lines in a key's index have one length, so an entry probes for what is shorter by as much as its own rule says only:
    five keys an entry at most (threshold 2), however many share its key. What is too short to be split keeps its key.
    """
    parts = threshold + 1
    rules = F.array(*(F.struct(*(F.lit(v).alias(c) for c, v in zip(("shorter", "part", "shift"), r, strict=True))) for r in rules_of(threshold)))
    placed = entries.join(texts.select("id", "line"), "id").withColumn("_r", F.get(rules, F.col("rule").cast("int"))).withColumn("_other", F.char_length("line") - F.col("_r.shorter"))
    placed = placed.withColumn("_at", _begin(F.col("_other"), F.col("_r.part"), parts)).withColumn("_end", _begin(F.col("_other"), F.col("_r.part") + 1, parts))
    rest = F.concat(F.substring("line", F.lit(1), F.col("_at") + F.col("_r.shift")), F.substring("line", F.col("_end") + F.col("_r.shift") + 1, F.char_length("line")))
    placed = placed.withColumn("_rest", wide(rest)).withColumn("_length", (F.octet_length("_rest") / 4).cast("int"))
    # the rest of the shorter line has this length; both may be too short to be split
    finer = F.when(F.col("_other") - (F.col("_end") - F.col("_at")) < parts + threshold, F.array(F.lit(0).cast("long"))).otherwise(line_keys(F.col("_rest"), F.col("_length"), threshold, F.col("_r.shorter")))
    keys = F.explode(F.array_distinct(F.transform(finer, lambda k: F.xxhash64("key", k)))).alias("key")
    return placed.select("id", "rule", *COUNTS, "component", "largest", keys)


def line_links(docs: DataFrame, distinct: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """node, component: the components of distinct lines, by their ids, that are within the threshold of each other."""
    shared = stored(shared_keys(distinct, threshold))
    own = shared.select("id").distinct()
    lines = split_lines(docs).select(line_id(F.col("line")).alias("id"), "line")
    texts = stored(lines.join(limited(own, BROADCAST_ROWS), "id", "left_semi").distinct())
    counts = texts.select("id", *(symbol_counts(F.col("line"), x).alias(c) for c, x in zip(COUNTS, SYMBOLS, strict=True))).dropDuplicates(["id"])
    shared = stored(shared.join(counts, "id").select(*ENTRY, "hot"))
    same = F.col("x.key") == F.col("y.key")
    few = shared.where("NOT hot")
    pairs = few.alias("x").join(few.alias("y"), same & (F.col("x.id") < F.col("y.id")) & may_be_near("x", "y", threshold)).select(*_ends("x", "y"))
    hot = shared.where("hot")
    any_hot = not hot.isEmpty()
    if any_hot:
        copies = distinct.where("n > 1").select("id", "n")
        hot = stored(hot.join(limited(copies, BROADCAST_ROWS), "id", "left").select(*ENTRY, F.coalesce("n", F.lit(1)).alias("n")))
        centers = hot.where(F.col("rule") <= threshold).groupBy("key").agg(F.max_by(F.struct(*ENTRY[1:]), F.struct("n", "id")).alias("c")).select("key", "c.*")
        star = hot.alias("x").join(limited(stored_small(centers), BROADCAST_ROWS).alias("y"), same & (F.col("x.id") != F.col("y.id")) & may_be_near("x", "y", threshold))
        pairs = pairs.unionByName(star.select(*_ends("x", "y")))
    tried = stored(pairs.distinct())
    found = stored_small(components(verified(tried, texts, threshold)))

    def more(pairs: DataFrame) -> None:
        nonlocal tried, found
        fresh = stored_small(pairs.select(*_ends("x", "y")).distinct().join(tried, ["a", "b"], "left_anti"))
        if fresh.isEmpty():
            return
        tried = tried.unionByName(fresh)
        stars = found.select(F.col("node").alias("a"), F.col("component").alias("b"))
        found = stored_small(components(stars.unionByName(verified(fresh, texts, threshold))))

    if any_hot and not (known := _apart(hot, found)).isEmpty():
        minima = [F.min_by(F.struct(*ENTRY[1:], "component"), F.xxhash64("id", F.lit(k))).alias(f"m{k}") for k in range(TRIED)]
        members = known.where((F.col("component") == F.col("largest")) & (F.col("rule") <= threshold)).groupBy("key").agg(*minima)
        members = members.select("key", F.explode(F.array_distinct(F.array(*(f"m{k}" for k in range(TRIED))))).alias("m")).select("key", "m.*")
        more(known.where("component <> largest").alias("x").join(limited(stored_small(members), BROADCAST_ROWS).alias("y"), same & may_be_near("x", "y", threshold)))
        if not (known := _apart(hot, found)).isEmpty():
            finer = stored(_finer(known, texts, threshold))
            different = (F.col("x.component") != F.col("y.component")) & ((F.col("y.component") == F.col("y.largest")) | (F.col("x.id") < F.col("y.id")))
            more(finer.where("component <> largest").alias("x").join(finer.alias("y"), same & different & may_be_near("x", "y", threshold)))
    return found


def dropped_lines(docs: DataFrame, threshold: int = THRESHOLD, least_chars: int | None = None) -> DataFrame:
    """key, mark, nos: the numbers of the lines of each document that go."""
    least = threshold + 1 if least_chars is None else max(least_chars, threshold + 1)
    distinct = stored(distinct_lines(docs, threshold, least))
    found = line_links(docs, distinct, threshold)
    linked = found.unionByName(found.select(F.col("component").alias("node"), "component").distinct())
    # a line that is linked with none is known by both its hashes
    again = distinct.where("n > 1").join(limited(linked, BROADCAST_ROWS), F.col("id") == F.col("node"), "left_anti")
    classes = stored_small(linked.select(F.col("node").alias("id"), F.col("component").alias("class"), F.lit(None).cast("long").alias("check")).unionByName(again.select("id", F.col("id").alias("class"), "check")))
    places = split_lines(docs).select(line_id(F.col("line")).alias("id"), line_check(F.col("line")).alias("_check"), "key", "mark", "no")
    known = places.join(limited(classes, BROADCAST_ROWS), "id").where(F.col("check").isNull() | (F.col("check") == F.col("_check")))
    known = stored(known.select("class", F.coalesce("check", F.lit(-1)).alias("check"), "key", "mark", "no"))
    stay = known.groupBy("class", "check").agg(F.min(F.struct("key", "mark", "no")).alias("first")).select("first.*")
    stay = stay.groupBy("key", "mark").agg(F.collect_list("no").alias("stay"))
    each = known.groupBy("key", "mark").agg(F.collect_set("no").alias("nos")).join(stay, ["key", "mark"], "left")
    gone = each.select("key", "mark", F.array_sort(F.array_except("nos", F.coalesce("stay", F.array().cast("array<int>")))).alias("nos"))
    return stored_small(gone.where(F.size("nos") > 0))


def _kept(lines: Column, nos: Column) -> Column:
    """The lines between the dropped ones, stretch by stretch."""

    def of(x: Column) -> Column:
        stretch = lambda k: F.slice(x["lines"], F.get(x["bounds"], k) + 2, F.get(x["bounds"], k + 1) - F.get(x["bounds"], k) - 1)
        return F.flatten(F.transform(F.sequence(F.lit(0), F.size(x["bounds"]) - 2), stretch))

    return _named(lines, lambda x: _named(F.struct(x.alias("lines"), F.concat(F.array(F.lit(-1)), nos, F.array(F.size(x))).alias("bounds")), of))


def _with_nos(docs: DataFrame, id_col: str, text_col: str, threshold: int, least_chars: int | None) -> DataFrame:
    """docs and, as _nos, the numbers of the lines that go (null: none)."""
    gone = dropped_lines(id_text(docs, id_col, text_col), threshold, least_chars).select(F.col("key").alias("_key"), F.col("mark").alias("_mark"), F.col("nos").alias("_nos"))
    same = (F.coalesce(docs[id_col].cast("long"), F.lit(-(1 << 63))) == F.col("_key")) & (F.xxhash64(docs[text_col].cast("string")) == F.col("_mark"))
    return docs.join(limited(gone, BROADCAST_ROWS, F.size("_nos"), BROADCAST_NUMBERS), same, "left").drop("_key", "_mark")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = THRESHOLD, least_chars: int | None = None) -> DataFrame:
    """docs with the repeated lines taken out of text_col. A text that had lines and has none left but blank ones is null."""
    columns = docs.columns
    marked = _with_nos(docs, id_col, text_col, threshold, least_chars)
    text = F.when(F.col("_nos").isNull(), F.col(text_col)).otherwise(F.array_join(_kept(F.split(text_col, "\n"), F.col("_nos")), "\n"))
    cleaned = marked.withColumn(text_col, F.when(F.col("_nos").isNotNull() & (F.trim(text) == ""), F.lit(None)).otherwise(text))
    return cleaned.select(*columns)


def line_report(docs: DataFrame, threshold: int = THRESHOLD, least_chars: int | None = None) -> DataFrame:
    """doc_id, n_lines, n_dropped, dropped (line numbers from 0, comma-joined) and the text that stays, one row per document."""
    marked = _with_nos(id_text(docs), "doc_id", "text", threshold, least_chars)
    nos = F.coalesce("_nos", F.array().cast("array<int>"))
    lines = F.split("text", "\n")
    return marked.select(
        "doc_id", F.coalesce(F.size(lines), F.lit(0)).cast("long").alias("n_lines"), F.size(nos).cast("long").alias("n_dropped"), F.array_join(nos.cast("array<string>"), ",").alias("dropped"),
        F.when(F.col("_nos").isNull(), F.col("text")).otherwise(F.array_join(_kept(lines, nos), "\n")).alias("text"),
    )
