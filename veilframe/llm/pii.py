"""Personal data: exact base patterns, and contextual patterns bootstrapped from what these find.

Everything here is DataFrame functions, and linear in a text. The base patterns are written so that the regular
expression engine neither recurses nor rescans: possessive quantifiers, and starts only where a longer run can't begin.
Places come from prefix sums over the pieces between matches, overlaps from running maxima over sorted spans.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import kept, own_names, scratch, text_of

#: Kinds in the order of the results, each with an expression that finds the same spans as its definition.
LOCAL, DOMAIN = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
PATTERNS = {
    "email": rf"(?:(?<!{LOCAL})|\G){LOCAL}++@{DOMAIN}++(?:\.{DOMAIN}++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9]){15,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A kind without base pattern: credentials, which seeds by form or name and contexts alone find.
SECRET = "secret"
KINDS = (*PATTERNS, SECRET)
#: What a text must hold for a kind to be looked for.
HINTS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
#: Tokens that may be identifiers: runs with a digit or an at-sign between blanks, quotes and marks that separate values.
PART = r"\s\"'`=,;<>|{}"
TOKEN = rf"(?<![^{PART}])[^{PART}0-9@]*+[0-9@][^{PART}]*+"
#: Runs of digit groups, each bare or in brackets, with at most one blank, dot or hyphen between two.
GROUP = r"(?:\([0-9]++\)|[0-9]++)"
RUN, SPACED = rf"(?<![^\s\"'(\[<=:,;])\+?{GROUP}(?:[\x20.-]?+{GROUP})++", r"[0-9]\)?\x20\(?[0-9]"
#: Marks that may stand at a candidate's ends without being part of it.
OPENING, CLOSING = r"^[^\p{L}\p{N}+(@]++", r"[^\p{L}\p{N})]++$"
#: Forms of credentials that public services issue, and words that name a credential.
ISSUED = r"^(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{16,}|eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,})$"
NAMES = r"^(?:.*[^a-z])?(?:token|secret|passwd|password|passphrase|api[_-]?key|access[_-]?key|private[_-]?key|auth|bearer|credentials?)(?:[^a-z].*)?$"
#: A pattern needs so many distinct instances of its kind, and this share among all it goes with; an instance this score.
MIN_SUPPORT, MIN_PATTERN, MIN_INSTANCE = 4, 0.8, 0.8
#: How much an instance of no known kind that looks like the pattern's counts against it; any other counts 1.
DOUBT = 0.2
#: Most texts with discovered spans, and most such spans, that are broadcast (about 100 bytes each); with more, Spark joins by a shuffle.
MAX_BROADCAST = 100_000
#: Elements of an array that a fold goes over at once, since appending copies what is there.
BLOCK = 128

SPAN = "struct<kind:string,start:bigint,end:bigint>"


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once however often it occurs."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _running(xs: Column, step: Callable[[Column, Column], Column]) -> Column:
    """step(step(0, x0), x1) ... for each bigint of a bound array: folds of BLOCK elements, so that no copy grows with its length."""

    def block(done: Column, nth: Column) -> Column:
        last = F.element_at(F.element_at(done, -1), -1)
        return F.array_append(done, F.aggregate(F.slice(xs, nth * BLOCK + 1, F.lit(BLOCK)), F.array(last), lambda out, x: F.array_append(out, step(F.element_at(out, -1), x))))

    blocks = F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / BLOCK).cast("int"))
    # each block begins with the end of the one before it, the first of all with 0
    done = F.aggregate(blocks, F.array(F.array(F.lit(0).cast("long"))), block)
    return F.when(F.size(xs) > 0, F.flatten(F.transform(done, lambda out: F.slice(out, 2, F.lit(BLOCK))))).otherwise(F.array().cast("array<bigint>"))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _valid(kind: str, value: Column) -> Column:
    """Whether a match counts: parts up to 255, the Luhn sum of 16 to 19 digits, 8 to 15 digits."""
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: _let(F.ltrim(p, F.lit("0")), lambda low: F.when(F.length(low) <= 3, F.concat(F.lit("0"), low).cast("int") <= 255).otherwise(False)))
    if kind == "phone":
        return F.length(_digits(value)).between(8, 15)
    if kind == "card":

        def luhn(number: Column) -> Column:
            doubled = F.transform(F.split(F.reverse(number), ""), lambda d, i: d.cast("int") * (i % 2 + 1))
            total = F.aggregate(doubled, F.lit(0), lambda s, x: s + F.when(x > 9, x - 9).otherwise(x))
            return F.when(F.length(number).between(16, 19), total % 10 == 0).otherwise(False)

        return _let(_digits(value), luhn)
    return F.lit(True)


def of_kind(*kinds: str) -> Callable[[Column], Column]:
    """Of a span: whether it is of one of these kinds."""
    return lambda span: span["kind"].isin(*kinds)


def _like(value: Column) -> Column:
    """Kinds whose form a candidate has, loosely: what keeps patterns from drifting."""

    def kinds(digits: Column) -> Column:
        length = F.length(value)
        phone = digits.between(7, 15) & (digits * 2 > length) & ~value.contains("@")
        card = digits.between(12, 19) & (digits * 4 > length * 3)
        ip = (value.contains(".") | value.contains(":")) & value.rlike(r"^[0-9A-Fa-f]{0,4}(?:[.:][0-9A-Fa-f]{0,4}){3,7}$")
        email = (value.contains("@") | value.contains("at")) & value.rlike(r"[A-Za-z0-9]@[A-Za-z0-9]|\(at\)|\[at\]")
        secret = (length >= 8) & (digits > 0) & (digits < length) & value.rlike(r"^[A-Za-z0-9+/_.~!$%^&*#-]++=*+$") & value.rlike("[A-Za-z]")
        return F.array_compact(F.array(*(F.when(test, F.lit(k)) for k, test in zip(KINDS, (email, ip, card, phone, secret), strict=True))))

    return _let(F.length(_digits(value)), kinds)


def _words(before: Column, after: Column) -> Column:
    """The last two words of `before` (null if there is none) and the first one of `after`, lower-cased; by scans from the text's near end."""

    def last(turned: Column, nth: int) -> Column:
        return F.nullif(F.reverse(F.regexp_extract(turned, r"^[\s\"'`(\[<{]*+(\S++)(?:\s++(\S++))?", nth)), F.lit(""))

    first = F.nullif(F.lower(F.regexp_extract(after, r"^[\s\"'`)\]>}.,;:!?]*+(\S++)", 1)), F.lit(""))
    return _let(F.lower(F.reverse(before)), lambda turned: F.struct(last(turned, 1).alias("last"), last(turned, 2).alias("second"), first.alias("first")))


def _patterns(words: Column) -> Column:
    """Lexical patterns of a mention, each as 16 bytes: the word before it, the two before it, the words before and after it."""
    last, second, first = words["last"], words["second"], words["first"]
    texts = (F.concat(F.lit("L "), last), F.concat(F.lit("LL "), second, F.lit(" "), last), F.concat(F.lit("LR "), last, F.lit(" _ "), first))
    return F.array_compact(F.array(*(F.unhex(F.md5(t)) for t in texts)))


def _matches(pattern: str, hint: Column, finish: Callable[[Column, Column, Column, Column], Column], ok: Callable[[Column], Column]) -> Column:
    """finish(value, start, before, after) of each match of `pattern` in `body` for which ok(value) holds, in an array.

    before and after are as much of the text around a match as holds two words and one, if there are so many between
    the matches next to it. Pieces of the text are looked at a fixed number of times each.
    """
    pieces = F.zip_with(F.split("body", pattern, -1), F.regexp_extract_all("body", F.lit(pattern), F.lit(0)), lambda gap, value: F.struct(gap.alias("gap"), value.alias("value")))
    none = F.array().cast("array<struct<gap:string,value:string>>")

    def placed(pieces: Column, starts: Column) -> Column:
        def near(i: Column, part: str) -> Column:
            return F.coalesce(F.get(pieces, i)[part], F.lit(""))

        def one(p: Column, i: Column) -> Column:
            before = F.concat(near(i - 2, "gap"), near(i - 2, "value"), near(i - 1, "gap"), near(i - 1, "value"), p["gap"])
            after = F.concat(near(i + 1, "gap"), near(i + 1, "value"))
            return F.when(p["value"].isNotNull() & F.coalesce(ok(p["value"]), F.lit(False)), finish(p["value"], F.get(starts, i), before, after))

        return F.array_compact(F.transform(pieces, one))

    def found(pieces: Column) -> Column:
        steps = F.transform(pieces, lambda p, i: (F.length(p["gap"]) + F.when(i > 0, F.coalesce(F.length(F.get(pieces, i - 1)["value"]), F.lit(0))).otherwise(0)).cast("long"))
        starts = _let(steps, lambda xs: _running(xs, lambda at, x: at + x))
        return F.when(F.size(pieces) > 1, _let(starts, lambda s: placed(pieces, s))).otherwise(F.array())

    return _let(F.when(hint, pieces).otherwise(none), found)


def _shape(value: Column) -> Column:
    """A value's form: letters as a or A (runs as one), digits as 9 (runs of up to three as one), marks as they are."""
    letters = F.regexp_replace(F.regexp_replace(value, r"\p{Lu}++", "A"), r"[\p{L}&&[^\p{Lu}]]++", "a")
    return F.regexp_replace(F.regexp_replace(letters, "[0-9]", "9"), "(?<!9)9{1,3}(?!9)", "9")


def _fits(value: Column, alike: Column) -> Column:
    """Of the base kinds that a candidate looks like, those whose test it passes."""
    return F.array_compact(F.array(*(F.when(F.array_contains(alike, k), F.when(F.coalesce(_valid(k, value), F.lit(False)), F.lit(k))) for k in PATTERNS)))


MENTION = "struct<form:string,kind:string,start:bigint,end:bigint,value:binary,alike:array<string>,patterns:array<binary>,shape:binary,fits:array<string>>"


def _mention(form: str, kind: Column, start: Column, value: Column, alike: Column, words: Column) -> Column:
    fits = F.array(kind) if form == "base" else _fits(value, alike)
    return F.struct(
        F.lit(form).alias("form"), kind.alias("kind"), start.alias("start"), (start + F.length(value)).alias("end"),
        F.unhex(F.md5(value)).alias("value"), alike.alias("alike"), _patterns(words).alias("patterns"),
        F.when(F.size(fits) > 0, F.unhex(F.md5(F.concat(F.lit("S "), F.array_join(fits, " "), F.lit(" "), _shape(value))))).alias("shape"), fits.alias("fits"),
    ).cast(MENTION)


def _bounds(span: Column) -> Column:
    return F.struct(span["kind"].alias("kind"), span["start"].alias("start"), span["end"].alias("end")).cast(SPAN)


def with_base(docs: DataFrame) -> DataFrame:
    """docs (with a string `body`) and `mentions`: of form 'base', the spans of each kind in PATTERNS' order, by start within a kind.

    Matches are leftmost and don't overlap within a kind; those that fail their kind's test are dropped.
    """

    def finish(kind: str) -> Callable[[Column, Column, Column, Column], Column]:
        return lambda value, start, before, after: _mention("base", F.lit(kind), start, value, F.array(F.lit(kind)), _words(before, after))

    def found(kind: str, pattern: str) -> Column:
        hint = F.col("body").contains(HINTS[kind]) if HINTS[kind] else F.col("body").rlike("[0-9]")
        return _matches(pattern, hint, finish(kind), lambda value: _valid(kind, value)).cast(f"array<{MENTION}>")

    return docs.withColumn("mentions", F.concat(*(found(k, p) for k, p in PATTERNS.items())))


def with_candidates(docs: DataFrame) -> DataFrame:
    """docs (body, mentions) with candidates among the mentions, too: of form 'token' and 'run'.

    Tokens hold a digit or an at-sign; they count in the contexts of patterns even where they look like no kind. Runs of
    digit groups with blanks inside are candidates if they look like a kind, besides the tokens they consist of. A token
    of an issued form, or long and named as a credential by one of the two words before it, is a seed of SECRET.
    """

    def candidate(form: str) -> Callable[[Column, Column, Column, Column], Column]:
        def finish(value: Column, start: Column, before: Column, after: Column) -> Column:
            def own(inner: Column, tail: Column) -> Column:
                at = start + F.length(tail) - F.length(inner)

                def seen(words: Column, alike: Column) -> Column:
                    # words are lower-cased already; the one before an equals sign may be joined with it
                    named = F.coalesce(words["last"].rlike(NAMES), F.lit(False)) | F.coalesce(words["second"].rlike(NAMES) & words["last"].rlike("^[^a-z]*$"), F.lit(False))
                    seed = F.array_contains(alike, SECRET) & (F.length(inner) >= 14) & (inner.rlike(ISSUED) | ((F.length(inner) >= 16) & named))
                    return _mention(form, F.when(F.lit(form == "token") & seed, SECRET).otherwise(""), at, inner, alike, words)

                shown = _let(_words(before, after), lambda words: _let(_like(inner), lambda alike: seen(words, alike)))
                # a run that goes on with a letter is none
                ends = F.lit(True) if form == "token" else ~after.rlike(r"^[^\s.,;:!?\"')\]>]")
                return F.when((inner != "") & ends, shown)

            return _let(F.regexp_replace(value, CLOSING, ""), lambda tail: _let(F.regexp_replace(tail, OPENING, ""), lambda inner: own(inner, tail)))

        return finish

    def whole(value: Column) -> Column:
        """A run with a blank, of a kind's form; one without is a token."""
        return value.contains(" ") & (F.size(_like(value)) > 0)

    tokens = _matches(TOKEN, F.col("body").rlike("[0-9@]"), candidate("token"), lambda value: F.lit(True))
    runs = _matches(RUN, F.col("body").rlike(SPACED), candidate("run"), whole)
    return docs.withColumn("mentions", F.concat("mentions", tokens.cast(f"array<{MENTION}>"), runs.cast(f"array<{MENTION}>")))


def bootstrap(edges: DataFrame) -> DataFrame:
    """(value, kind) of the identifiers that patterns discover, from edges (pattern, value, kind or '' if not known, alike).

    In each round a pattern's score for a kind is the share of its instances which that kind holds, each weighted with
    its own score (seeds: 1), if at least MIN_SUPPORT instances of the kind are known; unknown instances that look like
    the kind count DOUBT in the whole. An instance's score is that of at least one of its accepted patterns holding,
    1 - prod(1 - score), for the kind it looks like; it enters with the score it has in the round that accepts it.
    Rounds go on until one accepts nothing new. Scores are summed up in each task before a shuffle, so that a word
    before a third of all identifiers doesn't meet in one task.
    """
    edges = edges if "seeds_only" in edges.columns else edges.withColumn("seeds_only", F.lit(False))
    known = kept(edges.filter("kind != ''").select("value", "kind", F.lit(1.0).alias("score"), F.lit(True).alias("seed")).distinct())
    alike = [F.sum(((F.col("kind") == "") & F.array_contains("alike", k)).cast("int")).alias(k) for k in KINDS]
    degree = kept(edges.groupBy("pattern").agg(F.count(F.lit(1)).alias("n"), *alike))
    doubtful = F.coalesce(*(F.when(F.col("of") == k, F.col(k)) for k in KINDS))
    unknown, found = kept(edges.filter("kind = '' and size(alike) > 0").select("pattern", "value", "alike")), known.limit(0).select("value", "kind", "score")
    while True:
        support = edges.select("pattern", "value", "seeds_only").join(known.select("value", F.col("kind").alias("of"), "score", "seed"), "value").filter("seed or not seeds_only").groupBy("pattern", "of").agg(F.sum("score").alias("sum"), F.count(F.lit(1)).alias("many"))
        good = support.filter(F.col("many") >= MIN_SUPPORT).join(degree, "pattern").withColumn("held", F.col("sum") / (F.col("n") - (1 - DOUBT) * doubtful)).filter(F.col("held") >= MIN_PATTERN)
        good = kept(good.select("pattern", "of", F.least(F.col("held"), F.lit(0.99)).alias("held")))
        new = unknown.join(found, "value", "left_anti").join(good, "pattern").filter(F.expr("array_contains(alike, of)"))
        scored = new.groupBy("value", "of").agg((1 - F.exp(F.sum(F.log(1 - F.col("held"))))).alias("score")).filter(F.col("score") >= MIN_INSTANCE)
        best = kept(scored.groupBy("value").agg(F.max_by(F.struct("of", "score"), F.struct("score", "of")).alias("best")).select("value", F.col("best.of").alias("kind"), F.col("best.score").alias("score")))
        if best.isEmpty():
            return found.select("value", "kind")
        found = kept(found.unionByName(best))
        known = kept(known.unionByName(best.withColumn("seed", F.lit(False))))


def _apart(spans: DataFrame) -> DataFrame:
    """Mentions (text_key, form, start, end, ...) without candidates that overlap a base span of their text."""
    base = F.col("form") == "base"
    up = Window.partitionBy("text_key").orderBy("start", F.desc("end"), F.desc(base)).rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy("text_key").orderBy(F.desc("start"), F.desc(base)).rowsBetween(Window.unboundedPreceding, 0)
    # base spans that start with or before a candidate, and with or after it; those that start with it may be in either window
    marked = spans.withColumn("_end", F.max(F.when(base, F.col("end"))).over(up)).withColumn("_next", F.min(F.when(base, F.col("start"))).over(down))
    clear = (F.coalesce(F.col("_end") <= F.col("start"), F.lit(True))) & (F.coalesce(F.col("_next") >= F.col("end"), F.lit(True)))
    return marked.filter(base | clear).drop("_end", "_next")


def graph_of(seen: DataFrame) -> DataFrame:
    """Edges (pattern, value, kind, alike, seeds_only) of mentions: to the words around each, and to its own shape.

    A shape is induced by seeds alone: that some values of a form were discovered by their contexts says nothing of others.
    Which kinds' tests a candidate passes is part of its shape: a number of a card's length with a wrong check digit has
    another one than cards. Under a shape it looks like those kinds alone; one that passes none has no shape.
    """
    words = seen.select(F.explode("patterns").alias("pattern"), "value", "kind", "alike", F.lit(False).alias("seeds_only"))
    shapes = seen.filter("shape is not null").select(F.col("shape").alias("pattern"), "value", "kind", F.col("fits").alias("alike"), F.lit(True).alias("seeds_only"))
    return words.unionByName(shapes).distinct()


def recovered(docs: DataFrame, held_out: float = 0.5, seed: int = 29) -> DataFrame:
    """(kind, held_out, found, wrong): how many base values, hidden by a hash of the value, the other ones' patterns find.

    A hidden value stands in the graph as a candidate of no known kind, looking like its own kind alone; wrong counts
    those that come out as another. What else is found, which no base pattern has, is not counted here.
    """
    rows = with_candidates(with_base(docs.select(text_of().alias("body")))).select(F.unhex(F.sha2("body", 256)).alias("text_key"), "mentions")
    texts = kept(rows.filter(F.size("mentions") > 0)).groupBy("text_key").agg(F.any_value("mentions").alias("mentions"))
    seen = kept(_apart(texts.select("text_key", F.explode("mentions").alias("m")).select("text_key", "m.*")))
    hidden = (F.col("form") == "base") & (F.pmod(F.xxhash64("value", F.lit(seed)), F.lit(1000)) < int(1000 * held_out))
    asked = kept(seen.filter(hidden).select("value", F.col("kind").alias("truth")).distinct())
    found = bootstrap(kept(graph_of(seen.withColumn("kind", F.when(hidden, F.lit("")).otherwise(F.col("kind"))))))
    both = asked.join(found, "value", "left")
    right = F.col("kind") == F.col("truth")
    return both.groupBy(F.col("truth").alias("kind")).agg(F.count(F.lit(1)).alias("held_out"), F.count_if(right).alias("found"), F.count_if(F.col("kind").isNotNull() & ~right).alias("wrong"))


def discovered(rows: DataFrame) -> DataFrame:
    """(text_key, extra): for each text with any, the spans found beside base ones, by start; from rows (text_key, mentions)."""
    texts = rows.filter(F.size("mentions") > 0).groupBy("text_key").agg(F.any_value("mentions").alias("mentions"))
    seen = kept(_apart(texts.select("text_key", F.explode("mentions").alias("m")).select("text_key", "m.*")))
    found = bootstrap(kept(graph_of(seen))).select("value", F.col("kind").alias("as"))
    open_ = seen.filter("form != 'base'").select("text_key", "kind", "start", "end", "value")
    spans = open_.filter("kind = ''").join(found, "value").select("text_key", F.col("as").alias("kind"), "start", "end")
    spans = spans.unionByName(open_.filter("kind != ''").select("text_key", "kind", "start", "end"))
    # a span inside one that starts earlier, or with it and is longer, goes
    before = Window.partitionBy("text_key").orderBy("start", F.desc("end"), "kind").rowsBetween(Window.unboundedPreceding, -1)
    outer = spans.withColumn("_far", F.max("end").over(before)).filter("_far is null or _far < end")
    return outer.groupBy("text_key").agg(F.array_sort(F.collect_list(F.struct("start", "end", "kind"))).alias("all")).select("text_key", F.transform("all", _bounds).alias("extra"))


@own_names
def find_personal_data(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Two tables: rows (doc_id, text_key, base) one per document, and extra (text_key, extra) one per text with discoveries.

    base and extra are arrays of kind, start, end; places are code points of the whole text, end exclusive. base holds
    what PATTERNS find. extra holds seeds of SECRET, and other tokens and runs of digit groups that the bootstrapped
    contexts take for personal data (see bootstrap), without those inside a longer one, wherever in the corpus the same
    value stands. Null and empty texts have none; rows with a null or repeated doc_id are documents of their own; other
    columns are ignored; an empty table gives empty results.
    """
    source = docs.select("doc_id", text_of().alias("body"))
    found = with_candidates(with_base(source)).select("doc_id", F.unhex(F.sha2("body", 256)).alias("text_key"), "mentions")
    rows = kept(found)
    base = F.transform(F.filter("mentions", lambda m: m["form"] == "base"), _bounds)
    with scratch(docs.sparkSession):
        extra = kept(discovered(rows.select("text_key", "mentions")), lasting=True)
    return rows.select("doc_id", "text_key", base.alias("base")), extra


def with_extra(rows: DataFrame, extra: DataFrame) -> DataFrame:
    """rows (with text_key) and their `extra` spans, an empty array where there are none."""
    size = extra.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("extra")), F.lit(0))).first()
    if max(size) <= MAX_BROADCAST:
        extra = F.broadcast(extra)
    return rows.join(extra, "text_key", "left").withColumn("extra", F.coalesce("extra", F.array().cast(f"array<{SPAN}>")))


def spans_text(spans: Column) -> Column:
    """kind:start:end of spans, by kind in KINDS' order, then start; comma-joined."""
    order = F.create_map(*(x for i, k in enumerate(KINDS) for x in (F.lit(k), F.lit(i))))
    placed = F.array_sort(F.transform(spans, lambda s: F.struct(order[s["kind"]], s["start"], s["end"], s["kind"].alias("k"))))
    return F.array_join(F.transform(placed, lambda s: F.concat_ws(":", s["k"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def mask(body: Column, spans: Column) -> Column:
    """The text with each span, or run of overlapping ones, replaced by the first one's kind in angle brackets.

    The text is cut into stretches of BLOCK spans, and each of these into its pieces, so that no piece is looked for
    from the start of a long text.
    """
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))

    def stretch(at: Column, spans: Column, ends: Column) -> Column:
        """The text from the end of the spans before the at-th to that of the last of BLOCK spans."""
        last = F.least(at + BLOCK, F.size(spans)) - 1
        begin = F.coalesce(F.get(ends, at - 1), F.lit(0).cast("long"))

        def pieces(text: Column) -> Column:
            def one(i: Column) -> Column:
                span, seen = F.get(spans, i), F.coalesce(F.get(ends, i - 1), F.lit(0).cast("long"))
                piece = F.substring(text, (seen - begin + 1).cast("int"), (span["start"] - seen).cast("int"))
                return F.when(span["start"] >= seen, F.concat(piece, F.lit("<"), F.upper(span["kind"]), F.lit(">"))).otherwise("")

            return F.array_join(F.transform(F.sequence(at, last), one), "")

        return _let(F.substring(body, (begin + 1).cast("int"), (F.get(ends, last) - begin).cast("int")), pieces)

    def masked(spans: Column, ends: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(0), F.size(spans) - 1, F.lit(BLOCK)), lambda at: stretch(at, spans, ends))
        tail = F.substring(body, (F.element_at(ends, -1) + 1).cast("int"), F.length(body))
        return F.concat(F.array_join(parts, ""), tail)

    def far(spans: Column) -> Column:
        return _let(F.transform(spans, lambda s: s["end"]), lambda xs: _running(xs, lambda at, x: F.greatest(at, x)))

    return F.when(F.size(spans) > 0, _let(ordered, lambda spans: _let(far(spans), lambda ends: masked(spans, ends)))).otherwise(body)


@own_names
def mask_personal_data(docs: DataFrame) -> DataFrame:
    """docs, all columns and rows as they came, with personal data in `text` masked and n_chars (if there) brought up to date.

    Null and empty texts stay as they are, and so does n_chars where nothing is masked; rows with a null or repeated
    doc_id are documents like any other; an empty table stays empty. The texts are searched once, stored with their
    mentions, and masked when what the whole corpus taught is known.
    """
    row = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), text_of().alias("body"))
    found = kept(with_candidates(with_base(row)).select("row", F.unhex(F.sha2("body", 256)).alias("text_key"), "mentions"))
    with scratch(docs.sparkSession):
        extra = kept(discovered(found.select("text_key", "mentions")), lasting=True)
    base = F.transform(F.filter("mentions", lambda m: m["form"] == "base"), _bounds)
    spans = with_extra(found.select("row", "text_key", base.alias("base")), extra).select("row", F.concat("base", "extra").alias("spans"))
    done = spans.withColumn("masked", F.when(F.size("spans") > 0, mask(F.col("row.text").cast("string"), F.col("spans"))))
    changed = {"text": F.col("masked"), "n_chars": F.length("masked").cast("long")}
    return done.select(*(F.when(F.size("spans") > 0, changed[c]).otherwise(F.col(f"row.`{c}`")).alias(c) if c in changed else F.col(f"row.`{c}`").alias(c) for c in docs.columns))
