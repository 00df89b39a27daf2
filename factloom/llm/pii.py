"""Personal data by bootstrapped contextual extraction, in DataFrame operations only.

Base spans (email, ip, card, phone) are found by pattern and validity. They are the seeds: every identifier-like token
is an instance, known if a base span touches it. Its lexical patterns are the word before it, the two words before it, the word
after it, and the words on both sides together. Over all documents, patterns and instances score each other in rounds: a
pattern by the smoothed mean score of its distinct instances, an unknown instance by its best pattern. Instances that a
high-confidence pattern ends up vouching for are reported as spans of kind ``id``, beside the base spans, which always stay.

Documents of one text have one set of tokens in the graph. Tokens meet the base spans of their text by an equi-join on cells
of CELL characters, so that a text full of both takes time in proportion to its length.

Spans are in code points, end exclusive. Edge cases: a null text is an empty one and has no spans; repeated rows keep
their number and get equal results; a null id is carried along; an empty table gives no rows; columns other than the
two named are ignored. Whole texts are read; all patterns are possessive, so that no input makes them backtrack.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import cut, matches, scratch, sized

KINDS = ("email", "ip", "card", "phone", "id")
#: Equivalent to the plain patterns, but linear: possessive, and never started inside a run that an earlier start covers.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A run of identifier characters with a digit or an at sign in it.
TOKEN = r"(?<![A-Za-z0-9@._%+-])[A-Za-z._%+-]*+[0-9@][A-Za-z0-9@._%+-]*+"
#: What a token must look like to be an instance: like an address, or long with several digits.
INSTANCE = r"^[^@]++@[^@]|^(?=(?:[^0-9]*+[0-9]){2}).{8,}$"
ROUNDS = 3
#: Characters of a cell, in which tokens meet base spans.
CELL = 256
#: Rows of patterns, and of texts with further spans, that are sent to every executor; more are joined by shuffle.
SENT = 500_000
#: Spans that are masked together.
_RUN = 64
#: Distinct known instances a pattern needs, its smoothing, and the score from which it vouches for others.
SUPPORT, SMOOTHING, CONFIDENT = 3, 1.0, 0.6
MASKS = {k: f"<{k.upper()}>" for k in KINDS}


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    back = F.reverse(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(back, i, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 1, d).when(d > 4, d * 2 - 9).otherwise(d * 2)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _valid(kind: str, text: Column) -> Column:
    if kind == "ip":
        part = r"0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])?"
        return text.rlike(rf"^{part}(?:\.{part}){{3}}$")
    digits = _digits(text)
    if kind == "card":
        return F.when(F.length(digits).between(12, 19), _luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def _base(text: Column, kind: str) -> Column:
    shape = "struct<start:int,end:int,text:string>"
    spans = matches(text, F.lit(PATTERNS[kind]), lambda s, e, m, b, a: F.struct(s.alias("start"), e.alias("end"), m.alias("text")), shape, ["start", "end"])
    return F.transform(F.filter(spans, lambda x: _valid(kind, x["text"])), lambda x: F.struct(x["start"], x["end"]))


def _tokens(text: Column) -> Column:
    shape = "struct<start:int,end:int,text:string,left:string,far:string,right:string>"
    word, gap = r"([\p{L}\p{N}]++)", r"[^\p{L}\p{N}]"

    def make(s: Column, e: Column, m: Column, b: Column, a: Column) -> Column:
        lead = F.length(m) - F.length(F.regexp_replace(m, r"^[@._%+-]++", ""))
        bare = F.regexp_replace(m, r"[@._%+-]++$", "")
        return F.struct(
            (s + lead).alias("start"), (s + F.length(bare)).alias("end"), F.substring(bare, lead + 1, F.length(bare)).alias("text"),
            F.lower(F.regexp_extract(F.right(b, F.lit(48)), rf"{word}{gap}*+$", 1)).alias("left"),
            F.lower(F.regexp_extract(F.right(b, F.lit(96)), rf"{word}{gap}++[\p{{L}}\p{{N}}]++{gap}*+$", 1)).alias("far"),
            F.lower(F.regexp_extract(F.left(a, F.lit(48)), rf"^{gap}*+{word}", 1)).alias("right"),
        )

    return F.filter(matches(text, F.lit(TOKEN), make, shape, ["start", "end"]), lambda x: x["text"].rlike(INSTANCE))


def _key(text: Column) -> Column:
    """Every span has a digit or an at sign in it."""
    return F.when(text.rlike("[0-9@]"), F.sha2(text.cast("binary"), 256))


def base_spans(docs: DataFrame, text_col: str, prefix: str = "") -> DataFrame:
    """``docs`` with key, email, ip, card, phone and tokens (``prefix`` before each name): arrays of spans, and of tokens with
    the words around them. ``key`` is the text's digest, null for texts that can have no span."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    some = text.rlike("[0-9@]")
    gates = {"email": text.contains("@"), "phone": text.contains("+"), "ip": some, "card": some}
    none = F.array().cast("array<struct<start:int,end:int>>")
    spans = [F.when(gates[k], _base(text, k)).otherwise(none).alias(prefix + k) for k in KINDS[:4]]
    tokens = F.when(some, _tokens(text)).otherwise(F.array().cast("array<struct<start:int,end:int,text:string,left:string,far:string,right:string>>"))
    return docs.select("*", _key(text).alias(f"{prefix}key"), *spans, tokens.alias(f"{prefix}tokens"))


def _cells(start: Column, end: Column) -> Column:
    return F.explode(F.sequence(F.floor(start / CELL).cast("int"), F.floor((end - 1) / CELL).cast("int")))


def instances(found: DataFrame) -> DataFrame:
    """(key, start, end, text, known, pattern): every token of every distinct text, once for each of its patterns."""
    base = F.flatten(F.array(*KINDS[:4]))
    texts = found.where(F.size("tokens") > 0).select("key", "tokens", base.alias("base")).dropDuplicates(["key"])
    tokens = cut(texts.select("key", F.explode("tokens").alias("t")).select("key", "t.*"), "tokens")
    spans = cut(texts.select("key", F.explode("base").alias("b")).select("key", F.col("b.start").alias("b_start"), F.col("b.end").alias("b_end")), "seeds")
    placed = tokens.select("key", "start", "end", _cells(F.col("start"), F.col("end")).alias("cell"))
    seeds = spans.select("key", "b_start", "b_end", _cells(F.col("b_start"), F.col("b_end")).alias("cell"))
    touched = placed.join(seeds, ["key", "cell"]).where((F.col("b_start") < F.col("end")) & (F.col("start") < F.col("b_end")))
    touched = touched.select("key", "start").distinct().withColumn("touched", F.lit(True))
    told = tokens.join(touched, ["key", "start"], "left").withColumn("known", F.coalesce("touched", F.lit(False)))
    return told.select("key", "start", "end", F.lower("text").alias("instance"), "known", F.explode(_patterns()).alias("pattern"))


def _patterns() -> Column:
    left, far, right = F.col("left"), F.col("far"), F.col("right")
    before, behind = F.when(left != "", F.concat(F.lit("before "), left)), F.when(right != "", F.concat(F.lit("after "), right))
    phrase = F.when((left != "") & (far != ""), F.concat(F.lit("before "), far, F.lit(" "), left))
    around = F.when((left != "") & (right != ""), F.concat(F.lit("around "), left, F.lit(" "), right))
    return F.array_compact(F.array(before, phrase, behind, around))


def pattern_scores(seen: DataFrame, rounds: int = ROUNDS, support: int = SUPPORT) -> DataFrame:
    """(pattern, score) of every lexical pattern with enough known instances, or vouched for by those that have."""
    edges = cut(seen.groupBy("instance", "pattern").agg(F.max("known").alias("known")), "graph")
    # An instance that is known anywhere is known everywhere.
    scores = edges.groupBy("instance").agg(F.max(F.col("known").cast("double")).alias("score"))
    patterns = None
    for n in range(rounds):
        rated = edges.join(scores, "instance").groupBy("pattern").agg(F.sum("score").alias("good"), F.count(F.lit(1)).alias("n"))
        rated = rated.where(F.col("good") >= support).select("pattern", (F.col("good") / (F.col("n") + SMOOTHING)).alias("score"))
        patterns = cut(rated, "patterns", keep=n == rounds - 1)
        vouched = edges.join(sized(patterns, SENT), "pattern").groupBy("instance").agg(F.max("known").alias("known"), F.max("score").alias("score"))
        scores = vouched.select("instance", F.when(F.col("known"), 1.0).when(F.col("score") >= CONFIDENT, F.col("score")).otherwise(0.0).alias("score"))
    return patterns


def _extra(found: DataFrame, rounds: int, support: int) -> DataFrame:
    """(text_key, extra): spans of kind ``id`` of the texts that have any."""
    with scratch(found.sparkSession):
        seen = cut(instances(found), "instances")
        confident = cut(pattern_scores(seen, rounds, support).where(F.col("score") >= CONFIDENT).select("pattern"), "confident")
        unknown = seen.where("NOT known").join(sized(confident, SENT), "pattern")
        spans = unknown.groupBy("key").agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("extra"))
        return cut(spans.select(F.col("key").alias("text_key"), "extra"), "extra-spans", keep=True)


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS, support: int = SUPPORT) -> DataFrame:
    """One row per document: id, key (see ``base_spans``), the four base span arrays, and ``extra``, the spans of kind
    ``id`` that patterns vouch for."""
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    found = cut(base_spans(rows, "text").drop("text"), "spans")
    spans = sized(_extra(found, rounds, support), SENT)
    none = F.array().cast("array<struct<start:int,end:int>>")
    joined = found.join(spans, found["key"] == spans["text_key"], "left")
    return joined.select("id", "key", *KINDS[:4], F.coalesce("extra", none).alias("extra"))


def _ordered(kinds: tuple[str, ...], prefix: str = "") -> Column:
    """Structs (start, kind as its place in ``kinds``, end), sorted."""

    def tagged(n: int, kind: str) -> Column:
        return F.transform(prefix + ("extra" if kind == "id" else kind), lambda s: F.struct(s["start"].alias("start"), F.lit(n).alias("kind"), s["end"].alias("end")))

    return F.sort_array(F.flatten(F.array(*[tagged(n, k) for n, k in enumerate(kinds)])))


def _joined(*kinds: str) -> Column:
    """Spans of the kinds as kind:start:end, by start, then kind as listed."""
    names = F.array(*[F.lit(k) for k in kinds])
    return F.concat_ws(",", F.transform(_ordered(kinds), lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])))


def report(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts of base spans, their digest, and all spans, from ``find``."""
    return found.select(
        F.col("id").alias(id_col),
        *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[:4]],
        F.sha2(_joined(*KINDS[:4]).cast("binary"), 256).alias("base_sha256"),
        _joined(*KINDS).alias("spans"),
    )


def _masked(text: Column, spans: Column) -> Column:
    """``text`` with a mask for every span; overlapping ones become one, named by the first. Spans are taken in runs, each over
    its own stretch of the text."""
    masks = F.array(*[F.lit(MASKS[k]) for k in KINDS])
    heads = F.when(F.size(spans) > 0, F.sequence(F.lit(0), F.floor((F.size(spans) - 1) / _RUN).cast("int"))).otherwise(F.array().cast("array<int>"))
    runs = F.transform(heads, lambda h: F.slice(spans, h * _RUN + 1, F.lit(_RUN)))

    def step(acc: Column, run: Column) -> Column:
        def over(x: Column) -> Column:
            def one(a: Column, s: Column) -> Column:
                fresh = s["start"] >= a["at"]
                gap = F.substring(x["stretch"], a["at"] - x["base"] + 1, s["start"] - a["at"])
                out = F.when(fresh, F.concat(a["out"], gap, F.get(masks, s["kind"]))).otherwise(a["out"])
                return F.struct(F.greatest(a["at"], s["end"]).alias("at"), out.alias("out"))

            return F.aggregate(run, F.struct(x["base"].alias("at"), F.lit("").alias("out")), one)

        last = F.get(F.slice(run, -1, 1), 0)["start"]
        stretch = F.substring(text, acc["at"] + 1, F.greatest(last - acc["at"], F.lit(0)))
        # An array of one, transformed, is a name for its element: the stretch is cut out once a run.
        done = F.get(F.transform(F.array(F.struct(acc["at"].alias("base"), stretch.alias("stretch"))), over), 0)
        return F.transform(F.array(done), lambda d: F.struct(d["at"].alias("at"), F.concat(acc["out"], F.array(d["out"])).alias("out")))[0]

    first = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    return F.aggregate(runs, first, step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["at"] + 1, F.length(text))))


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS, support: int = SUPPORT) -> DataFrame:
    """``docs`` with every span replaced by a mask of its kind; overlapping spans become one, named by the first. Texts are kept
    beside their spans and not shuffled, as long as few enough texts have spans of kind ``id``."""
    prefix = "pii"
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix += "_"
    found = cut(base_spans(docs, text_col, prefix), "redacting")
    names = ["key", *KINDS[:4], "tokens"]
    spans = sized(_extra(found.select(*[F.col(prefix + n).alias(n) for n in names]), rounds, support), SENT)
    spans = spans.withColumnsRenamed({"text_key": f"{prefix}text_key", "extra": f"{prefix}extra_spans"})
    none = F.array().cast("array<struct<start:int,end:int>>")
    rows = found.join(spans, F.col(f"{prefix}key") == F.col(f"{prefix}text_key"), "left").withColumn(f"{prefix}extra", F.coalesce(f"{prefix}extra_spans", none))
    rows = rows.withColumn(f"{prefix}all", _ordered(KINDS, prefix))
    text = F.col(f"`{text_col}`")
    masked = F.when(F.size(f"{prefix}all") > 0, _masked(text, F.col(f"{prefix}all"))).otherwise(text)
    return rows.select(*[masked.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns])
