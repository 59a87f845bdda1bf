"""Personal data: candidate spans, boosted trees, calibrated thresholds; DataFrame functions only.

Base spans are leftmost non-overlapping matches of four kinds, each with a check (octets, digit
counts, Luhn); a match that fails its check is dropped. On top of them high-recall generators
propose candidates: long mixed tokens (kind secret), local phone numbers (phone) and spelled-out
addresses (email). Each generator runs on its own, so their proposals may overlap. Boosted trees
score each candidate by its format and the characters before it; of those over the threshold of
their kind that touch no base span the likeliest of overlapping ones are added. Base spans stay.

The trees are trained here on examples made by rule (EXAMPLES of them, a documented bound), with
features computed by the same columns, and are then columns themselves, so the main path stays in
the JVM. Rows that no tree has seen calibrate the margins to probabilities, and fix a threshold for
each kind: the least at which PRECISION of the kind's accepted rows are right. Patterns are written
with possessive quantifiers and look-behinds so that the time is linear in the text; they match what
the plain forms in the comments match.

Positions are in code points, end exclusive. Defined cases: null text is empty and has no spans;
repeated rows get equal results; of overlapping candidates of equal probability the longer stays,
then the first; texts are taken whole, whatever their length; other columns are ignored; an empty
table gives no rows.
"""

from __future__ import annotations

import random
import string

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import boosting

KINDS = ("email", "ip", "card", "phone", "secret")
EXAMPLES, PRECISION, CONTEXT = 3000, 0.98, 24

#: [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+  A match may begin inside a run only where the last one ended.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
#: [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
#: [0-9]([\x20-]?[0-9])+
CARD = r"[0-9](?:[\x20-]?[0-9])++"
#: \+[0-9][\x20().0-9-]+[0-9]
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"

_TOKEN = r"(?<![A-Za-z0-9_-])(?=[A-Za-z_-]*+[0-9])[A-Za-z0-9_-]{16,}+"
_LOCAL = r"(?<![0-9A-Za-z.+)-])(?<!\+[0-9] )\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z-])"
_SPELLED = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?[\[(]\x20?(?:at|AT)\x20?[\])]\x20?[A-Za-z0-9-]++(?:\x20?(?:\.|[\[(]\x20?(?:dot|DOT)\x20?[\])])\x20?[A-Za-z0-9-]{2,}+)++"
GENERATORS = (_TOKEN, _LOCAL, _SPELLED)
_CUE = r"(?i)(?:token|key|secret|passw|pwd|auth|bearer|api|credential|phone|tel|call|fax|mobile|cell|mail|contact|reach)[a-z_]{0,8}[^A-Za-z0-9]{0,5}$"
_BLOCK = 128


def _spans(text: Column, pattern: str, guard: Column) -> Column:
    """Matches as array<struct<start, end, s>>. Ends are summed in blocks, so that many matches cost little more than linear time."""
    empty = F.array().cast("array<struct<start:int,end:int,s:string>>")
    found = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.split(text, pattern, -1).alias("p"))

    def whole(x: Column) -> Column:
        m, p = x["m"], x["p"]
        n = F.size(m)
        start = F.struct(F.lit(0).alias("at"), empty.alias("out"))

        def one(acc: Column, i: Column) -> Column:
            lo = acc["at"] + F.length(F.get(p, i))
            hi = lo + F.length(F.get(m, i))
            return F.struct(hi.alias("at"), F.array_append(acc["out"], F.struct(lo.alias("start"), hi.alias("end"), F.get(m, i).alias("s"))).alias("out"))

        def block(acc: Column, b: Column) -> Column:
            inner = F.aggregate(F.sequence(b, F.least(b + (_BLOCK - 1), n - 1)), F.struct(acc["at"].alias("at"), empty.alias("out")), one)
            return F.struct(inner["at"].alias("at"), F.concat(acc["out"], inner["out"]).alias("out"))

        return F.when(n > 0, F.aggregate(F.sequence(F.lit(0), n - 1, F.lit(_BLOCK)), start, block)["out"]).otherwise(empty)

    return F.when(guard & text.rlike(pattern), F.transform(F.array(found), whole)[0]).otherwise(empty)


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def add(acc: Column, i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return acc + F.when((F.length(digits) - i) % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _octets(s: Column) -> Column:
    def small(part: Column) -> Column:
        plain = F.regexp_replace(part, "^0+(?=.)", "")
        return F.when(F.length(plain) > 3, F.lit(False)).otherwise(plain.cast("int") <= 255)

    return F.forall(F.split(s, r"\."), small)


def _between(n: Column, lo: int, hi: int) -> Column:
    return (n >= lo) & (n <= hi)


def base_spans(text: Column) -> dict[str, Column]:
    return {
        "email": _spans(text, EMAIL, F.contains(text, F.lit("@"))),
        "ip": F.filter(_spans(text, IP, F.lit(True)), lambda x: _octets(x["s"])),
        "card": F.filter(_spans(text, CARD, F.lit(True)), lambda x: _between(F.length(_digits(x["s"])), 13, 19) & _luhn(_digits(x["s"]))),
        "phone": F.filter(_spans(text, PHONE, F.contains(text, F.lit("+"))), lambda x: _between(F.length(_digits(x["s"])), 9, 15)),
    }


def _features(s: Column, before: Column) -> list[Column]:
    def without(pattern: str) -> Column:
        return F.length(F.regexp_replace(s, pattern, ""))

    return [
        F.length(s),
        without("[^0-9]"),
        without("[^A-Z]"),
        without("[^a-z]"),
        without("[A-Za-z0-9]"),
        F.size(F.array_distinct(F.split(s, ""))),
        F.length(F.regexp_replace(s, "[A-Za-z]*[0-9]+|[A-Za-z]+", "x")),  # runs of letters and digits
        s.rlike("^[0-9a-f]+$").cast("int"),
        s.rlike("^[0-9A-Z]+$").cast("int"),
        s.rlike("[A-Za-z]").cast("int"),
        s.rlike(r"[\[(](?i:\x20?at\x20?)[\])]").cast("int"),
        before.rlike(_CUE).cast("int"),
        before.rlike("[=:\"']\\s?$").cast("int"),
        F.length(F.regexp_extract(s, "(?<![A-Za-z])([A-Za-z]*+)$", 1)),
        without("[^g-z]"),
    ]


def candidates(text: Column) -> Column:
    """array<struct<start, end, kind, f>> of all proposals, with their features."""

    def described(c: Column) -> Column:
        s = c["s"]
        before = F.substring(text, F.greatest(c["start"] - CONTEXT, F.lit(0)) + 1, F.least(c["start"], F.lit(CONTEXT)))
        kind = F.when(s.rlike(r"[\[(]"), F.when(s.rlike("[A-Za-z]"), F.lit("email")).otherwise(F.lit("phone"))).when(s.rlike("[A-Za-z]"), F.lit("secret")).otherwise(F.when(s.rlike("[ .-]"), F.lit("phone")).otherwise(F.lit("secret")))
        return F.struct(c["start"].alias("start"), c["end"].alias("end"), kind.alias("kind"), F.array(*(f.cast("double") for f in _features(s, before))).alias("f"))

    def proposed(g: int, guard: Column) -> Column:
        return F.transform(_spans(text, GENERATORS[g], guard), lambda c: described(c).withField("g", F.lit(g)))

    return F.concat(proposed(0, F.lit(True)), proposed(1, F.lit(True)), proposed(2, text.rlike(r"[\[(]\x20?(?:at|AT)\x20?[\])]")))


def _overlap(x: Column, y: Column) -> Column:
    return (x["start"] < y["end"]) & (y["start"] < x["end"])


def _resolved(found: Column) -> Column:
    """Of candidates(start, end, kind, g, p) that overlap the likeliest stays (then the longest, then the first). Those of one generator never overlap."""
    rare = F.filter(found, lambda x: x["g"] != 0)
    meets = lambda c: F.when(c["g"] == 0, F.exists(rare, lambda x: _overlap(x, c))).otherwise(F.exists(found, lambda x: (x["g"] != c["g"]) & _overlap(x, c)))
    order = F.array_sort(F.transform(F.filter(found, meets), lambda c: F.struct((-c["p"]).alias("p"), (c["start"] - c["end"]).alias("n"), c["start"].alias("start"), c["end"].alias("end"), c["kind"].alias("kind"))))
    bare = lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), c["kind"].alias("kind"))
    none = F.array().cast("array<struct<start:int,end:int,kind:string>>")
    best = F.aggregate(order, none, lambda kept, c: F.when(F.exists(kept, lambda x: _overlap(x, c)), kept).otherwise(F.array_append(kept, bare(c))))
    return F.concat(F.transform(F.filter(found, lambda c: ~meets(c)), bare), best)


def _examples(n: int, seed: int = 11) -> list[tuple[str, str, int]]:
    """(text before, candidate, label) made by rule."""
    r, low, up, dig = random.Random(seed), string.ascii_lowercase, string.ascii_uppercase, string.digits
    pick = lambda letters, k: "".join(r.choice(letters) for _ in range(k))
    syllables = ["ka", "to", "ren", "mi", "so", "la", "ver", "an", "du", "pel", "or", "in", "ta", "ex", "ion", "ing"]
    word = lambda: "".join(r.choice(syllables) for _ in range(r.randint(1, 4)))
    cue = lambda: r.choice(["token = \"", "api_key: ", "secret=", "password=", "Authorization: Bearer ", "key=", "auth "])
    out = []
    for i in range(n):
        before, kind = f"{word()} {word()} ", i % 12
        if kind == 0:
            out.append((before + r.choice([cue(), cue(), ""]), pick("0123456789abcdef", r.choice([16, 18, 20, 24, 32, 40, 64])), 1))
        elif kind == 1:
            out.append((before + r.choice([cue(), "", ""]), r.choice(["AKIA", "ASIA", "AIza", ""]) + pick(up + dig, r.choice([16, 20, 24])), 1))
        elif kind == 2:
            out.append((before + r.choice([cue(), cue(), ""]), r.choice(["ghp_", "sk-", "xoxb-", ""]) + pick(low + up + dig, r.randint(20, 48)), 1))
        elif kind == 3:
            out.append((before + r.choice(["phone ", "tel: ", "call ", "fax ", "mobile: "]), f"{r.randint(200, 999)}{r.choice('-. ')}{r.randint(200, 999)}{r.choice('-. ')}{pick(dig, 4)}", 1))
        elif kind == 4:
            out.append((before + r.choice(["call ", ""]), f"({r.randint(200, 999)}) {r.randint(200, 999)}-{pick(dig, 4)}", 1))
        elif kind == 5:
            out.append((before + r.choice(["mail ", "contact ", ""]), f"{word()}.{word()} {r.choice(['[at]', '(at)'])} {word()}{r.choice(['.', ' [dot] ', '(dot)'])}com", 1))
        elif kind == 6:
            out.append((before, f"{word()}_{word()}_{word()}_{r.randint(1, 2030)}_{word()}", 0))
        elif kind == 7:
            out.append((before, "-".join([word(), word(), str(r.randint(2, 99)), word(), word(), word()]), 0))
        elif kind == 8:
            out.append((before, "".join(w.capitalize() for w in (word(), word(), word(), word())) + str(r.randint(1, 99)), 0))
        elif kind == 9:
            out.append((before, f"{r.randint(100, 999)} {r.randint(100, 999)} {r.randint(1000, 9999)}", 0))
        elif kind == 10:
            out.append((before, r.choice([f"20{pick(dig, 2)}-0{r.randint(1, 9)}-{pick('12', 2)}T{pick(dig, 2)}-{pick(dig, 2)}-00", pick(dig, r.randint(16, 24)), f"{word()}{word()}{word()}{word()}{pick(dig, r.randint(1, 4))}{word()}"]), 0))
        else:
            out.append((before, f"{word()}-{word()}-v{r.randint(1, 20)}-{r.randint(0, 9)}-{word()}-{word()}", 0))
    return out


_MODELS: dict[int, tuple[boosting.Boosted, dict[str, float]]] = {}


def thresholds(p: np.ndarray, y: np.ndarray, kind: list[str], precision: float = PRECISION) -> dict[str, float]:
    """By kind, the least probability from which on `precision` of the rows at or above it are right; over 1 if there is none."""
    out = {}
    for k in KINDS:
        mine = np.array([x == k for x in kind], bool)
        at, right = p[mine], y[mine]
        good = [t for t in np.unique(at).tolist() if right[at >= t].mean() >= precision]
        out[k] = min(good, default=2.0)
    return out


def model(spark: SparkSession, examples: int = EXAMPLES) -> tuple[boosting.Boosted, dict[str, float]]:
    """Trees trained on the examples, whose features Spark computes, and the threshold of each kind; kept for the life of the driver."""
    if examples not in _MODELS:
        made = [(i, b + c + r_end, len(b), y) for i, (b, c, y) in enumerate(_examples(examples)) for r_end in ((" ore", '" an', ".")[i % 3],)]
        rows = spark.createDataFrame(made, "i int, text string, at int, y int").select("i", "y", "at", candidates(F.col("text")).alias("c"))
        got = rows.select("i", "y", F.filter("c", lambda c: (c["start"] <= F.col("at")) & (c["end"] > F.col("at"))).alias("c")).where(F.size("c") > 0).select("i", "y", F.col("c")[0]["kind"].alias("kind"), F.col("c")[0]["f"].alias("f")).orderBy("i").collect()  # at most `examples` rows
        x, y = np.array([r["f"] for r in got]), np.array([r["y"] for r in got], np.float64)
        trees, unseen = boosting.fit(x, y), boosting.held(len(x))
        _MODELS[examples] = trees, thresholds(trees.probability(x[unseen]), y[unseen], [r["kind"] for r, u in zip(got, unseen, strict=True) if u])
    return _MODELS[examples]


def pii(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) for every row of docs(doc_id, text, ...)."""
    boosted, least = model(docs.sparkSession)
    enough = lambda c: F.coalesce(*(F.when(c["kind"] == k, c["p"] >= t) for k, t in least.items()))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("t"))
    t = F.col("t")
    place = "array<struct<start:int,end:int>>"
    bare = lambda a: F.transform(a, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"))).cast(place)
    found = rows.select("doc_id", *(bare(c).alias(k) for k, c in base_spans(t).items()), candidates(t).alias("c"))
    width = len(_features(F.lit(""), F.lit("")))
    base = F.concat(*(F.col(k) for k in KINDS[:4]))
    free = lambda c: ~F.exists(base, lambda x: _overlap(x, c))
    rated = lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), c["kind"].alias("kind"), c["g"].alias("g"), boosted.probability_column([c["f"][i] for i in range(width)]).alias("p"))
    sure = found.withColumn("sure", F.filter(F.transform(F.filter("c", free), rated), enough))
    added = sure.withColumn("added", _resolved(F.col("sure")))
    named = lambda k, a: F.transform(a, lambda x: F.concat(F.lit(k + ":"), x["start"].cast("string"), F.lit(":"), x["end"].cast("string")))
    of_kind = lambda k: bare(F.filter("added", lambda c: c["kind"] == k))
    of = {k: of_kind(k) for k in KINDS}
    every = F.concat(*(named(k, F.array_sort(F.concat(F.col(k), of[k]) if k != "secret" else of[k])) for k in KINDS))
    return added.select(
        "doc_id",
        *(F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[:4]),
        F.sha2(F.array_join(F.concat(*(named(k, F.col(k)) for k in KINDS[:4])), ","), 256).alias("base_sha256"),
        F.array_join(every, ",").alias("spans"),
    )
