"""Personal data and secrets by base patterns and by contexts learned from what they find.

Base. Four patterns find e-mail and IP addresses, card and phone numbers, each kind leftmost and
without overlap; matches that fail their test (octets, Luhn, digits) are dropped. The text between
two matches and the matches themselves give the places, by running sums of their lengths.

Bootstrap. Spans like identifiers are instances: the base shapes, runs of digits with single separators
or brackets (four or more digits), tokens of six or more characters with four or more digits, addresses
without digits (``a@b``, ``a[at]b.c``, ``@name``, whole tokens with an inner dot or underscore), and quoted
values after ``=`` or ``:``. Seeds are the base shapes that pass their test and, as the kind "secret", long
tokens of letters and digits whose characters have a high entropy. A secret is only reported where a
learned context confirms it: a digest in running text is none.

The one to three words beside an instance are its patterns ("what follows ``token = "``"). Texts are cut
into lower-case words at white space and at the edges of instances, and a line end is a word, so a
pattern may be a part of a token, an assignment or the start of a line. Precision counts one unit above
and below: a different neighbour of the pattern in a different text, where all instances of a text are
one neighbour. So copies of a text, or a word repeated before the same neighbour, count once. The
confidence of an instance is the noisy-or of the best pattern on each side. Both scores are updated in
turn over the graph of patterns and instances, for ``rounds`` rounds; instances that are more ``likely``
than not count for their patterns in the next round, by their confidence. Spans extracted by a pattern of a precision of at
least ``confident`` with at least ``support`` different identifiers become spans of that pattern's kind;
those that touch a base span do not.

Most words that stand beside an instance are no patterns. They go by a bound on their precision, from
the texts that have instances; what is below ``floor`` carries no weight (one such pattern on each side
does not make an instance likely). Only texts with the rarest word of a pattern that is left are cut and
counted besides.

The patterns are written so that a long run of one character class is scanned once. All steps are
DataFrame operations; what is shuffled are different texts with instances, matches, and words counted
before the shuffle.

Edge cases: a null text is empty; texts without matches have an empty list of spans; repeated rows
get equal results, also with one id over several texts; empty tables give empty results; other
columns are left out, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SLOTS, documents, has_bit, join_rows, mark, slot_bits, touched, written

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "secret")
_EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
_IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
# A whole run of digits with single separators, of 14 to 19 digits.
_CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,18}+(?![\x20-]?[0-9])"
_PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_PATTERNS = {"email": _EMAIL, "ip": _IP, "card": _CARD, "phone": _PHONE}
_GUARDS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}
# Other instances.
_FREE = r"(?<![A-Za-z0-9+@._%-])"
_TOKEN = _FREE + r"(?=(?:[A-Za-z@._%+-]*+[0-9]){4})[A-Za-z0-9+][A-Za-z0-9@._%+-]{4,}[A-Za-z0-9]"
_GROUP = r"[0-9]++(?![A-Za-z@_%])"
_RUN = _FREE + rf"[(+]?{_GROUP}(?:\)?(?:\x20-\x20|[\x20./-])?\(?{_GROUP})*+"
_AT = r"(?:@|(?i:\[at\]|\(at\)|\{at\}))"
_ADDRESS = _FREE + rf"(?:[A-Za-z0-9._%+-]++{_AT}[A-Za-z0-9-]++(?:(?:\.|(?i:\[dot\]|\(dot\)))[A-Za-z0-9-]++)*+|@[A-Za-z0-9_]++(?:[.-][A-Za-z0-9_]++)*+)"
_QUOTED = r"(?<=[=:]\x20?[\x22'])[^\x20\x09-\x0D\x22']{6,}+(?=[\x22'])"
_NAME = r"(?<![^\x20\x09-\x0D])[A-Za-z0-9]++(?:[._][A-Za-z0-9]++)++(?![:=])"
_ANY = "|".join((_EMAIL, _IP, _CARD, _PHONE, _QUOTED, _ADDRESS, _RUN, _TOKEN, _NAME))
_ANY_GUARD = r"[0-9@_]|[A-Za-z]\.[A-Za-z]|(?i:[\[({]at[\])}])|[=:]\x20?[\x22']"
_SPACE = r"\x20\x09-\x0D"
_HERE, _LINE = "\x01", "\x02"  # words that stand for an instance and for a line end
_WORDS = 3
_LONG, _ENTROPY = 20, 3.0


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Sum of the digits from the right, every second one doubled, is a multiple of ten."""
    def value(d: Column, i: Column) -> Column:
        twice = d.cast("int") * 2
        return F.when(i % 2 == 0, d.cast("int")).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    parts = F.transform(F.split(F.reverse(digits), ""), value)
    return F.aggregate(F.filter(parts, lambda x: x.isNotNull()), F.lit(0), lambda a, x: a + x) % 10 == 0


def _holds(kind: Column, m: Column) -> Column:
    n = F.length(_digits(m))
    octets = r"^0*(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(\.0*(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}$"
    return (
        F.when(kind == "email", F.lit(True))
        .when(kind == "ip", m.rlike(octets))
        .when(kind == "card", _luhn(_digits(m)))
        .otherwise(n.between(10, 15))
    )


def _cut(kind: str, pattern: str) -> Column:
    """The length of the text before every match with the match, and the rest of the text with none."""
    def row(gap: Column, m: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), F.length(gap).alias("gap"), m.alias("value"))

    return F.zip_with(F.split("text", pattern, -1), F.regexp_extract_all("text", F.lit(pattern), F.lit(0)), row)


def matches(docs: DataFrame) -> DataFrame:
    """Base matches that pass their test: (doc_id, mark, rid, kind, start, end)."""
    texts = docs.select("doc_id", mark().alias("mark"), F.coalesce("text", F.lit("")).alias("text"))
    texts = texts.withColumn("rid", F.monotonically_increasing_id())
    none = F.array().cast("array<struct<kind:string,gap:int,value:string>>")
    parts = [F.when(F.col("text").rlike(_GUARDS[kind]), _cut(kind, pattern)).otherwise(none) for kind, pattern in _PATTERNS.items()]
    # One generator over all kinds; a text without any has nothing to explode.
    rows = texts.select("doc_id", "mark", "rid", F.posexplode(F.concat(*parts)).alias("i", "r")).select("doc_id", "mark", "rid", "i", "r.*")
    rows = rows.withColumn("size", F.coalesce(F.length("value"), F.lit(0)))
    w = Window.partitionBy("rid", "kind").orderBy("i")
    placed = rows.withColumn("start", F.sum(F.col("gap") + F.col("size")).over(w) - F.col("size"))
    placed = placed.where(F.col("value").isNotNull() & _holds(F.col("kind"), F.col("value")))
    return placed.select("doc_id", "mark", "rid", "kind", "start", (F.col("start") + F.col("size")).alias("end"))


def _entropy(value: Column) -> Column:
    """Bits a character, by how often each stands in the value."""
    def bits(total: Column, c: Column) -> Column:
        share = (F.length(value) - F.length(F.replace(value, c, F.lit("")))) / F.length(value)
        return total - share * F.log2(share)

    return F.aggregate(F.array_distinct(F.filter(F.split(value, ""), lambda c: c != "")), F.lit(0.0), bits)


def _kind(value: Column) -> Column:
    """The kind of an instance: a base one, "secret" or "other"."""
    known = F.lit(None)
    for kind, pattern in reversed(_PATTERNS.items()):
        known = F.when(value.rlike(f"^(?:{pattern})$") & _holds(F.lit(kind), value), kind).otherwise(known)
    dense = value.rlike(rf"^[A-Za-z0-9+/_-]{{{_LONG},}}=*$") & value.rlike("[0-9]") & value.rlike("[A-Za-z]")
    return F.coalesce(known, F.when(dense & (_entropy(value) >= _ENTROPY), "secret").otherwise("other"))


def cut_texts(docs: DataFrame) -> DataFrame:
    """(mark, words, found) of every different text that may have instances: its words and its instances.

    ``found`` lists (value, start, at): where the instance starts in the text and among the words.
    """
    # The two signs that stand for something in the words are blanks in texts; lengths stay.
    texts = docs.select(mark().alias("mark"), F.translate("text", _HERE + _LINE, "  ").alias("text"))
    once = texts.where(F.col("text").rlike(_ANY_GUARD)).groupBy("mark").agg(F.any_value("text").alias("text"))
    parts = F.split("text", _ANY, -1)
    values = F.regexp_extract_all("text", F.lit(_ANY), F.lit(0))
    # The generator keeps the two lists from being computed again where they are used twice.
    both = once.select("mark", F.explode(F.array(F.struct(parts.alias("gaps"), values.alias("values")))).alias("c")).select("mark", "c.*")
    both = both.where(F.size("values") > 0)
    steps = F.zip_with(F.transform("gaps", lambda g: F.length(g)), F.transform("values", lambda v: F.length(v)), lambda g, v: F.named_struct(F.lit("g"), g, F.lit("v"), v))
    begun = F.struct(F.lit(0).alias("end"), F.array().cast("array<int>").alias("starts"))

    def add(done: Column, step: Column) -> Column:
        start = done["end"] + step["g"]
        return F.struct((start + step["v"]).alias("end"), F.concat(done["starts"], F.array(start)).alias("starts"))

    starts = F.aggregate(F.filter(steps, lambda s: s["v"].isNotNull()), begun, add, lambda done: done["starts"])
    words = words_of(F.array_join("gaps", f" {_HERE} "))
    rows = both.select("mark", "values", starts.alias("starts"), F.explode(F.array(words)).alias("words"))
    at = F.filter(F.sequence(F.lit(1), F.size("words")), lambda i: F.element_at("words", i) == _HERE)
    return rows.select("mark", "words", F.arrays_zip(F.col("values").alias("value"), F.col("starts").alias("start"), at.alias("at")).alias("found"))


def words_of(text: Column) -> Column:
    """The words of a text in lower case, line ends among them."""
    lines = F.replace(F.lower(text), F.lit("\n"), F.lit(f" {_LINE} "))
    return F.filter(F.split(lines, rf"[{_SPACE}]+"), lambda x: x != "")


def _patterns_at(words: Column, at: Column) -> Column:
    """(side, pattern) of the place ``at``: the runs of one to three words before and after, without instances."""
    n = F.size(words)

    def run(side: str, first: Column, size: int, fits: Column) -> Column:
        own = F.slice(words, F.when(fits, first).otherwise(1), F.when(fits, size).otherwise(0))
        fits = fits & ~F.array_contains(own, _HERE)
        return F.struct(F.lit(side).alias("side"), F.when(fits, F.array_join(own, " ")).alias("pattern"))

    runs = [run("after", at - k, k, at > k) for k in range(1, _WORDS + 1)] + [run("before", at + 1, k, at + k <= n) for k in range(1, _WORDS + 1)]
    return F.filter(F.array(*runs), lambda r: r["pattern"].isNotNull())


def instances(cut: DataFrame) -> DataFrame:
    """(mark, value, start, kind, sides): every instance with the patterns beside it."""
    rows = cut.select("mark", "words", F.explode("found").alias("f")).select("mark", "words", "f.*")
    return rows.select("mark", "value", "start", _kind(F.col("value")).alias("kind"), _patterns_at(F.col("words"), F.col("at")).alias("sides"))


def _slot(c: str) -> Column:
    return F.pmod(F.xxhash64(c), F.lit(SLOTS)).cast("int")


def _occurrences(texts: DataFrame, patterns: DataFrame) -> DataFrame:
    """(mark, side, pattern, next): the different neighbours of the patterns in each text of (mark, words).

    Runs that cannot be one of ``patterns`` (side, pattern) are left out before they become rows, so what is
    made and shuffled are the occurrences of patterns and no texts or other words. Only at the first words of
    patterns are runs judged, by the hash of their words, and only those that may be a pattern are spelled.
    """
    def run_slot(size: int, run: list[Column]) -> Column:
        return F.pmod(F.xxhash64(F.lit(size), *run), F.lit(SLOTS)).cast("int")

    own = patterns.select(F.split("pattern", " ").alias("words"))
    whole = F.coalesce(*(F.when(F.size("words") == size, run_slot(size, [F.get("words", F.lit(i)) for i in range(size)])) for size in range(1, _WORDS + 1)))
    slots = own.select(F.explode(F.array(run_slot(0, [F.get("words", F.lit(0))]), whole)).alias("slot"))
    wanted = F.broadcast(slot_bits(slots).withColumnRenamed("bits", "wanted"))
    texts = texts.where(F.size("words") > 0).select("mark", "words").join(wanted, how="cross")
    # The generator keeps the places from being computed again for every size.
    places = F.filter(F.sequence(F.lit(0), F.size("words") - 1), lambda at: has_bit("wanted", run_slot(0, [F.get("words", at)])))
    texts = texts.withColumn("places", F.explode(F.array(places)))

    def parts(size: int) -> Column:
        """The runs of so many words that may be a pattern, each as side, word on its other side, blank and run."""
        def run(at: Column) -> list[Column]:
            return [F.get("words", at + i) for i in range(size)]

        def spelled(at: Column) -> Column:
            after, before = (F.coalesce(F.get("words", i), F.lit("")) for i in (at + size, at - 1))
            return F.array(*(F.concat_ws(" ", F.concat(F.lit(side), beside), *run(at)) for side, beside in (("a", after), ("b", before))))

        fits = F.filter("places", lambda at: (at + size <= F.size("words")) & has_bit("wanted", run_slot(size, run(at))))
        return F.flatten(F.transform(fits, spelled))

    # Strings are told apart by a hash table; structs would be compared with each other.
    rows = texts.select("mark", F.explode(F.array_distinct(F.concat(*(parts(size) for size in range(1, _WORDS + 1))))).alias("s"))
    first, blank = F.substring("s", 1, 1), F.instr("s", " ")
    rest = F.substring("s", F.lit(2), blank - 2).alias("next")
    return rows.select("mark", F.when(first == "a", "after").otherwise("before").alias("side"), F.substring("s", blank + 1, F.length("s")).alias("pattern"), rest)


def _counted(occurrences: DataFrame, patterns: DataFrame) -> DataFrame:
    """(side, pattern, n): the occurrences of each of the patterns."""
    counts = occurrences.groupBy("side", "pattern").agg(F.count(F.lit(1)).alias("n"))
    return counts.join(patterns.select("side", "pattern"), ["side", "pattern"], "left_semi")


def _totals(docs: DataFrame, cut: DataFrame, patterns: DataFrame, floor: float) -> DataFrame:
    """(side, pattern, total): different neighbours over all texts, of the patterns that may matter.

    ``patterns`` has ``texts``, in how many an instance is beside the pattern; so many of them at most
    count for it, and the neighbours in texts with instances count against it.
    """
    near = written(_counted(_occurrences(cut, patterns), patterns), "neighbours")
    left = written(patterns.join(near, ["side", "pattern"]).where(F.col("texts") >= floor * F.col("n")).select("side", "pattern", "n"), "patterns")
    # The other texts: those that have the word of a pattern that is rarest in the texts with instances. Two
    # tables of slots, of at most SLOTS rows, keep other words and other texts from being shuffled.
    parts = left.select("side", "pattern", F.explode(F.split("pattern", " ")).alias("word"))
    often = cut.select(F.explode(F.array_distinct("words")).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("texts"))
    rare = parts.join(often, "word").groupBy("side", "pattern").agg(F.min_by("word", F.struct("texts", "word")).alias("word"))
    wanted = F.broadcast(written(rare.select(_slot("word").alias("slot")).distinct(), "rare-words"))
    hits = docs.select(mark().alias("mark"), F.explode(F.array_distinct(words_of(F.col("text")))).alias("word"))
    hits = written(hits.withColumn("slot", _slot("word")).join(wanted, "slot", "left_semi").select(_slot("mark").alias("slot")).distinct(), "hits")
    again = docs.select(mark().alias("mark"), "text").withColumn("slot", _slot("mark")).join(F.broadcast(hits), "slot", "left_semi")
    again = _occurrences(again.select("mark", F.explode(F.array(words_of(F.col("text")))).alias("words")), left)
    # Copies count once, and texts with instances are counted already.
    again = again.distinct().join(cut.select("mark"), "mark", "left_anti")
    more = _counted(again, left)
    both = left.unionByName(more.select("side", "pattern", "n"))
    return both.groupBy("side", "pattern").agg(F.sum("n").alias("total"))


def learned(docs: DataFrame, cut: DataFrame, found: DataFrame, confident: float, support: int, rounds: int, floor: float,
            likely: float = 0.499) -> DataFrame:
    """(side, pattern, kind, score) of the patterns that the graph makes confident."""
    edges = found.select("mark", "value", "kind", F.explode("sides").alias("s")).select("mark", "s.side", "s.pattern", "value", "kind").distinct()
    edges = written(edges, "edges")
    places = edges.groupBy("side", "pattern").agg(F.count_distinct("value").alias("values"), F.count_distinct("mark").alias("texts"))
    places = written(places.where(F.col("values") >= support), "places")
    totals = written(_totals(docs, cut, places, floor), "totals")
    edges = written(edges.join(totals.select("side", "pattern"), ["side", "pattern"]), "edges")
    seeds = edges.where("kind <> 'other'").withColumn("trust", F.lit(1.0)).withColumn("firm", F.lit(True))
    others, known = edges.where("kind = 'other'").drop("kind"), seeds
    pattern = ["side", "pattern", "kind"]
    for i in range(rounds + 1):
        # A text counts once for a pattern, by the best instance that it has there.
        texts = known.groupBy("mark", *pattern).agg(F.max("trust").alias("trust")).groupBy(*pattern).agg(F.sum("trust").alias("hits"))
        values = known.where("firm").groupBy(*pattern).agg(F.count_distinct("value").alias("values")).where(F.col("values") >= support)
        scores = texts.join(values, pattern).join(totals, ["side", "pattern"]).withColumn("score", F.least(F.col("hits") / F.col("total"), F.lit(1.0)))
        scores = written(scores.select(*pattern, "score"), "scores")
        if i == rounds:
            break
        # Patterns of one side share words and are no independent signs, so the best of each side counts.
        linked = others.select("side", "pattern", "value").distinct().join(scores, ["side", "pattern"])
        linked = linked.groupBy("value", "kind", "side").agg(F.max("score").alias("score"))
        none = F.log(F.greatest(1 - F.col("score"), F.lit(1e-9)))
        trusted = linked.groupBy("value", "kind").agg((1 - F.exp(F.sum(none))).alias("trust"), (F.max("score") >= confident).alias("firm"))
        trusted = written(trusted.where(F.col("trust") >= likely), "trusted")
        known = written(seeds.unionByName(others.join(trusted, "value").select(*seeds.columns)), "known")
    first = Window.partitionBy("side", "pattern").orderBy(F.desc("score"), "kind")
    best = scores.where(F.col("score") >= confident).withColumn("nth", F.row_number().over(first)).where("nth = 1")
    return best.select("side", "pattern", "kind", "score")


def found_in(docs: DataFrame, confident: float = 0.6, support: int = 5, rounds: int = 2, floor: float = 0.29) -> DataFrame:
    """(doc_id, mark, base, spans) of texts with spans, lists of (start, kind number, end)."""
    docs = docs.select("doc_id", "text")
    base = matches(docs)
    cut = written(cut_texts(docs), "cut")
    found = written(instances(cut), "instances")
    patterns = learned(docs, cut, found, confident, support, rounds, floor)
    more = found.where("kind in ('other', 'secret')").select("mark", "start", F.length("value").alias("size"), F.explode("sides").alias("s"))
    more = more.select("mark", "start", "size", "s.side", "s.pattern").join(patterns, ["side", "pattern"])
    more = more.groupBy("mark", "start", "size").agg(F.max_by("kind", F.struct("score", "kind")).alias("kind"))

    def number(names: str) -> Column:
        return F.array_position(F.array(*map(F.lit, KINDS)), F.col(names)).cast("int").alias("kind")

    span = F.struct(F.col("start").cast("long").alias("start"), number("kind"), (F.col("start") + F.col("size")).cast("long").alias("end"))
    new = written(more.groupBy("mark").agg(F.collect_list(span).alias("new")), "learned")
    keys = ["doc_id", "mark"]
    own = base.groupBy(*keys, "rid").agg(F.sort_array(F.collect_list(F.struct("start", number("kind"), "end"))).alias("base"))
    own = written(own.drop("rid").dropDuplicates(keys), "base")
    # Texts with learned spans and no base span have a row of their own.
    rows = docs.select("doc_id", mark().alias("mark")).join(new, "mark").dropDuplicates(keys)
    none = F.array().cast(own.schema["base"].dataType)
    both = own.withColumn("new", none).unionByName(rows.withColumn("base", none).select("doc_id", "mark", "base", "new"))
    both = both.groupBy(*keys).agg(F.max("base").alias("base"), F.max("new").alias("new"))  # the one that is not empty
    apart = F.filter("new", lambda x: ~F.exists("base", lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"])))
    return both.select(*keys, "base", F.sort_array(F.concat("base", apart)).alias("spans")).where(F.size("spans") > 0)


def find(docs: DataFrame, confident: float = 0.6, support: int = 5, rounds: int = 2, floor: float = 0.29) -> DataFrame:
    """Spans of every text: (doc_id, mark, base, spans), empty lists where there are none."""
    lists = found_in(docs, confident, support, rounds, floor)
    rows = docs.select("doc_id", mark().alias("mark"))
    kind = "array<struct<start:bigint,kind:int,end:bigint>>"
    joined = join_rows(rows, lists, "left")
    return joined.select("doc_id", "mark", *(F.coalesce(F.col(c).cast(kind), F.array().cast(kind)).alias(c) for c in ("base", "spans")))


def masked(docs: DataFrame, confident: float = 0.6, support: int = 5, rounds: int = 2, floor: float = 0.29) -> DataFrame:
    """``docs`` with every span of personal data and every secret replaced by its kind in brackets."""
    lists = written(found_in(docs, confident, support, rounds, floor).select("doc_id", "mark", "spans"), "spans")
    part, rest = touched(docs, lists)
    joined = join_rows(part, lists, "left").select("row", F.col("row.text").alias("text"), "spans")
    tags = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"))

    def add(done: Column, span: Column) -> Column:
        gap = F.substring(F.col("text"), (done["at"] + 1).cast("int"), (span["start"] - done["at"]).cast("int"))
        more = F.concat(done["out"], gap, F.element_at(tags, span["kind"]))
        # A span inside what is masked already only moves the end.
        return F.struct(F.greatest(done["at"], span["end"]).alias("at"), F.when(span["start"] >= done["at"], more).otherwise(done["out"]).alias("out"))

    rebuilt = F.aggregate("spans", start, add, lambda done: F.concat(done["out"], F.substring(F.col("text"), (done["at"] + 1).cast("int"), F.length("text"))))
    text = F.when(F.col("spans").isNull(), F.col("text")).otherwise(rebuilt)
    both = joined.withColumn("row", F.col("row").withField("text", text)).select("row.*").unionByName(rest)
    return both.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else both


def shown(spans: str) -> Column:
    """kind:start:end of every span, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(documents(spark, sf_dir))

    def count(spans: str, kind: str) -> Column:
        return F.size(F.filter(spans, lambda s: s["kind"] == KINDS.index(kind) + 1)).cast("long")

    counts = [count("base", k).alias(f"n_{k}") for k in BASE]
    return found.select("doc_id", *counts, F.sha2(shown("base"), 256).alias("base_sha256"), shown("spans").alias("spans"),
                        count("spans", "secret").alias("n_secret"), F.size("spans").cast("long").alias("n_spans"))
