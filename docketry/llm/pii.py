"""PII by candidate gradient boosting, in DataFrame functions only.

Base spans come from strict patterns with checks (octets, Luhn, digit counts). High-recall generators propose
further spans, which may overlap: spelled-out or spaced addresses, numbers with other separators or failing
checks. A candidate is a vector of yes/no features of its format and of the words before it. Boosted trees are
fitted for each kind on the candidates that the generators find in labelled sentences: planted personal data in
many spellings, and what looks like it but is none (versions, order numbers, times, numbers that fail their
check digit). The sentences are made by rule, the same at any size of the corpus; candidates are counted by
feature vector, so at most 2**features rows a kind reach the driver. Four fifths of the sentences fit the trees.
On the last fifth a kind's threshold is calibrated: the least score from which on the precision is `precision` or
more. The trees are evaluated as CASE expressions.

Added spans that overlap a base span or an added one before them are dropped; base spans always stay. Null or
empty text: no spans. Ties: kinds in the order listed, then starts. Rows that repeat are read each for itself.
Positions count code points. An empty table gives an empty result.
"""

from __future__ import annotations

import math
import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

KINDS = ("email", "ip", "card", "phone")

#: The contract's patterns. Runs are possessive and matches begin where a run begins or the last match ended,
#: which changes no match but keeps long runs from being read again and again.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}

#: What may be personal data at all. At most a few dozen characters each, so no run is long.
LOOSE = {
    "email": r"[A-Za-z0-9._%+-]{1,64}+\x20?(?:@|\(at\)|\[at\]|\{at\}|\x20at\x20)\x20?[A-Za-z0-9-]{1,63}+(?:\x20?(?:\.|\(dot\)|\[dot\]|\{dot\}|\x20dot\x20)\x20?[A-Za-z0-9-]{1,63}+){1,5}+",
    "ip": r"(?<![0-9.])[0-9]{1,3}(?:(?:\.|\[\.\]|\(\.\)|\x20\.\x20|\[dot\])[0-9]{1,3}){3}(?![0-9.]*[0-9])|(?<![0-9A-Fa-f:])[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){7}(?![0-9A-Fa-f:])",
    "card": r"(?<![0-9])[0-9]{4}[\x20._/-]{0,2}[0-9]{4}[\x20._/-]{0,2}[0-9]{4}[\x20._/-]{0,2}[0-9]{1,7}(?![0-9])|(?<![0-9])3[47][0-9]{2}[\x20._/-]?[0-9]{6}[\x20._/-]?[0-9]{5}(?![0-9])",
    "phone": r"(?<![0-9+])(?:\+|00)?[0-9]{0,3}[\x20./-]?\(?[0-9]{2,4}\)?[\x20./-][0-9]{3,4}[\x20./-][0-9]{3,4}(?![0-9])",
}

#: A cheap test that spares most texts the pattern itself.
HINT = {"email": r"@|(?i)[\[({\x20]at[\])}\x20]", "ip": r"[0-9]", "card": r"[0-9]", "phone": r"[0-9]"}

#: Words before a span that speak for its kind.
CUES = {
    "email": r"(?i)(mail|contact|write|reach|reply)",
    "ip": r"(?i)(\bip\b|addr|host|server|client|login)",
    "card": r"(?i)(card|visa|master|amex|credit|debit|pay|account)",
    "phone": r"(?i)(phone|tel|call|mobile|cell|fax|whatsapp|contact)",
}
AGAINST = r"(?i)(version|order|invoice|isbn|issn|total|amount|page|figure|table|section|ref|serial|#|\$|€|£)[^A-Za-z0-9]*$"
SPAN = "array<struct<kind:int,start:int,end:int,text:string>>"

#: Last labels that make a spelled-out address one.
DOMAINS = "com|org|net|edu|gov|io|info|co|uk|de|fr|es|it|nl|eu|us|ca|ch|at|be|au|jp"


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the check digit."""
    d = F.transform(F.reverse(F.split(digits, "(?<=.)(?=.)")), lambda x, i: F.when(i % 2 == 0, x.cast("int")).otherwise(x.cast("int") * 2 - F.when(x.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(d, F.lit(0), lambda a, x: a + x) % 10 == 0


def digits_of(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def valid(kind: str, text: Column) -> Column:
    digits = digits_of(text)
    n = F.length(digits)
    if kind == "ip":
        return F.forall(F.split(text, r"\."), lambda p: F.regexp_replace(p, "^0+", "").rlike("^([0-9]{0,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        return F.when((n >= 13) & (n <= 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return (n >= 9) & (n <= 15)
    return F.lit(True)


def running(values: Column, block: int = 128) -> Column:
    """Sums up to each element. In blocks, so that the work is not the square of the number of elements."""
    add = lambda x: F.aggregate(x, F.lit(0).cast("long"), lambda a, v: a + v)
    starts = F.sequence(F.lit(0), F.floor((F.size(values) - 1) / block).cast("int"))
    blocks = F.transform(starts, lambda k: F.slice(values, k * block + 1, F.lit(block)))

    def summed(bound):
        totals = F.transform(bound, add)
        ahead = F.transform(totals, lambda _, k: add(F.slice(totals, F.lit(1), k)))
        return F.flatten(F.zip_with(bound, ahead, lambda own, base: F.transform(own, lambda _, i: base + add(F.slice(own, F.lit(1), i + 1)))))

    return F.when(F.size(values) > 0, F.transform(F.array(blocks), summed)[0]).otherwise(F.array().cast("array<bigint>"))


def spans(text: Column, kind: str, pattern: str) -> Column:
    """Leftmost non-overlapping matches with their places: what lies between them adds up to their starts."""
    found, between = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    code = F.lit(KINDS.index(kind)).alias("kind")

    def placed(s):
        steps = F.zip_with(F.slice(s["b"], F.lit(1), F.size(s["f"])), s["f"], lambda g, m: (F.length(g) + F.length(m)).cast("long"))
        return F.zip_with(s["f"], running(steps), lambda m, end: F.struct(code, (end - F.length(m)).cast("int").alias("start"), end.cast("int").alias("end"), m.alias("text")))

    return F.transform(F.array(F.struct(found.alias("f"), between.alias("b"))), placed)[0].cast(SPAN)


def passes(kind: str):
    return lambda s: valid(kind, s["text"])


def base_spans(text: Column) -> Column:
    """All kinds' base spans, by kind and start."""
    parts = []
    for kind in KINDS:
        found = F.when(text.rlike(HINT[kind] if kind != "email" else "@"), spans(text, kind, BASE[kind])).otherwise(F.array().cast(SPAN))
        parts.append(F.filter(found, passes(kind)))
    return F.concat(*parts)


FEATURES = ("cue", "against", "check", "plain", "spaced", "dashed", "dotted", "wrapped", "lead", "bounded", "long", "letters")


def features(kind: Column, span: Column, before: Column, after: Column) -> dict[str, Column]:
    """Yes/no features of a candidate; before and after: the characters around it."""
    digits = digits_of(span)
    cue = F.coalesce(*[F.when(kind == i, before.rlike(CUES[k])) for i, k in enumerate(KINDS)])
    ip = F.regexp_replace(F.regexp_replace(span, r"(?i)\[dot\]", "."), r"[\[\]()\x20]", "")
    check = (
        F.when(kind == 0, span.rlike(rf"(?i)[^A-Za-z0-9]({DOMAINS})$"))
        .when(kind == 1, F.when(ip.contains(":"), ip.rlike("(?i)[a-f]")).otherwise(valid("ip", ip)))
        .when(kind == 2, F.when(F.length(digits).between(13, 19), luhn(digits)).otherwise(False))
        .otherwise(F.length(digits).between(9, 15))
    )
    return {
        "cue": cue,
        "against": before.rlike(AGAINST),
        "check": check,
        "plain": span.rlike(r"^[0-9]+$"),
        "spaced": span.contains(" "),
        "dashed": span.contains("-"),
        "dotted": span.contains("."),
        "wrapped": span.rlike(r"[\[({]"),
        "lead": span.rlike(r"^(\+|00)"),
        "bounded": ~before.rlike(r"[A-Za-z0-9_]$") & ~after.rlike(r"^[A-Za-z0-9_]"),
        "long": F.length(digits) >= 15,
        "letters": span.rlike(r"[A-Za-z]"),
    }


#: Sentences that teach the trees: for each kind and label, what may stand before a span, and the spellings of the span.
#: u a user, d a domain, t its last label, w any word; a b c e numbers to 255, h a group of hex digits; n a card number
#: that passes its check, x one that fails, by groups; p a phone number's groups; o numbers over 255 or of two digits.
TAUGHT = {
    (0, 1): (["mail me: ", "contact ", "write to ", "reach me at ", "", "reply to ", "her address: "], ["{u}@{d}.{t}", "{u} (at) {d} (dot) {t}", "{u} [at] {d} [dot] {t}", "{u} at {d} dot {t}", "{u} @ {d}.{t}", "{u}(at){d}.{t}", "{u} at {d}.{t}", "{u}{{at}}{d}{{dot}}{t}"]),
    (0, 0): (["look ", "we met ", "the point ", "contact them ", "sold ", ""], ["{w} at {w} dot {w}", "{w} @ {o}. {w}", "{w} at {w}. {w}", "{w} (at) {w}. {w}"]),
    (1, 1): (["ip ", "host ", "server ", "login from ", "", "seen "], ["{a}.{b}.{c}.{e}", "{a}[.]{b}[.]{c}[.]{e}", "{a}(.){b}(.){c}(.){e}", "{a}[dot]{b}[dot]{c}[dot]{e}", "{h}:{h}:{h}:{h}:{h}:{h}:{h}:a{h3}"]),
    (1, 0): (["version ", "section ", "", "figure ", "ip "], ["{o}[.]{big}[.]{o}[.]{o}", "{big} . {o} . {big} . {o}", "{o}:{o}:{o}:{o}:{o}:{o}:{o}:{o}"]),
    (2, 1): (["card ", "visa ", "pay with ", "credit card: ", "", "paid by "], ["{n0}{n1}{n2}{n3}", "{n0} {n1} {n2} {n3}", "{n0}-{n1}-{n2}-{n3}", "{n0}.{n1}.{n2}.{n3}", "{n0}/{n1}/{n2}/{n3}", "{n0}_{n1}_{n2}_{n3}", "{n0}  {n1}  {n2}  {n3}"]),
    (2, 0): (["order ", "serial ", "invoice ", "", "card ", "ref ", "the number "], ["{n0}{n1}{n2}{x3}", "{n0} {n1} {n2} {x3}", "{n0}-{n1}-{n2}-{x3}", "{n0}.{n1}.{n2}.{x3}"]),
    (3, 1): (["phone ", "call ", "tel. ", "mobile: ", "fax ", "contact "], ["({p0}) {p1}-{p2}", "{p0}-{p1}-{p2}", "{p0}.{p1}.{p2}", "0044 {p0} {p1} {p2}", "+44 {p0} {p1} {p2}", "{p0} {p1} {p2}"]),
    (3, 0): (["order ", "isbn ", "page ", "ref ", "invoice ", "version ", "", "they sold ", "between "], ["{p0}-{p1}-{p2}", "{p0}.{p1}.{p2}", "{p0} {p1} {p2}", "{o}/{p1}/{p2}"]),
}


def labelled_sentences(spark, n: int = 2400) -> DataFrame:
    """(doc_id, text, kind, start, end, label): one planted span a sentence, all spellings and contexts in turn; an inline table, always the same."""
    draw = random.Random(10)
    words = "river stone window paper garden music letter summer market silver number thing place story winter".split()
    shapes = [(kind, label, before, form) for (kind, label), (ahead, forms) in TAUGHT.items() for before in ahead for form in forms]
    number = lambda a, b: str(draw.randrange(a, b))
    rows = []
    for i in range(n):
        kind, label, before, form = shapes[i % len(shapes)]
        stem = "".join(number(0, 10) for _ in range(15))
        check = sum(int(c) if k % 2 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(stem[::-1])) * 9 % 10
        wrong = (check + draw.randrange(1, 10)) % 10
        fills = {
            "u": f"{draw.choice(words)}.{number(0, 90)}", "d": draw.choice(words) + number(0, 9), "t": draw.choice(DOMAINS.split("|")), "w": draw.choice(words),
            **{k: number(0, 256) for k in "abce"}, "h": f"{draw.randrange(4096, 65_536):04x}", "h3": f"{draw.randrange(4096):03x}", "o": number(10, 60), "big": number(300, 900),
            "n0": stem[:4], "n1": stem[4:8], "n2": stem[8:12], "n3": stem[12:] + str(check), "x3": stem[12:] + str(wrong), "p0": number(200, 900), "p1": f"{draw.randrange(1000):03d}", "p2": f"{draw.randrange(10_000):04d}",
        }
        head, span = f"{draw.choice(words)} {draw.choice(words)} {before}", form.format(**fills)
        rows.append(f"({i}, '{head}{span} and {draw.choice(words)}', {kind}, {len(head)}, {len(head) + len(span)}, {label})")
    return spark.sql("SELECT * FROM VALUES " + ", ".join(rows) + " AS t(doc_id, text, kind, start, end, label)")


def candidates(docs: DataFrame, *, id_col="doc_id", text_col="text") -> DataFrame:
    """(id, base, loose array<(kind, start, end, base, f)>): one row a document; base marks a candidate that meets a base span of its kind."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    loose = F.concat(*[F.when(text.rlike(HINT[k]), spans(text, k, LOOSE[k])).otherwise(F.array().cast(SPAN)) for k in KINDS])
    found = docs.select(F.col(id_col).alias("id"), text.alias("text"), base_spans(text).alias("base"), loose.alias("loose"))

    def judged(s):
        own = F.exists("base", lambda b: (b["kind"] == s["kind"]) & (b["start"] < s["end"]) & (b["end"] > s["start"]))
        from_ = F.greatest(F.lit(0), s["start"] - 40)
        before = F.substr(F.col("text"), from_ + 1, s["start"] - from_)
        after = F.substr(F.col("text"), s["end"] + 1, F.lit(1))
        f = [x.cast("int").alias(name) for name, x in features(s["kind"], s["text"], before, after).items()]
        return F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), own.alias("base"), F.struct(*f).alias("f"))

    bare = F.transform("base", lambda b: F.struct(b["kind"].alias("kind"), b["start"].alias("start"), b["end"].alias("end")))
    return found.select("id", bare.alias("base"), F.transform("loose", judged).alias("loose"))


def grow_tree(rows: list[tuple[tuple[int, ...], float, float, float]], depth: int, used: frozenset = frozenset()):
    """rows: (features, weight, gradient, curvature). A tree: a leaf's value, or (feature, no, yes)."""
    g, h = sum(r[2] for r in rows), sum(r[3] for r in rows)
    value = g / (h + 1.0)
    if depth == 0:
        return value
    best, gain = None, 1e-6
    for k in range(len(FEATURES)):
        if k in used:
            continue
        gy, hy = sum(r[2] for r in rows if r[0][k]), sum(r[3] for r in rows if r[0][k])
        won = gy * gy / (hy + 1) + (g - gy) ** 2 / (h - hy + 1) - g * g / (h + 1)
        if won > gain:
            best, gain = k, won
    if best is None:
        return value
    return best, *(grow_tree([r for r in rows if r[0][best] == side], depth - 1, used | {best}) for side in (0, 1))


def walk(tree, f: tuple[int, ...]) -> float:
    while isinstance(tree, tuple):
        tree = tree[2] if f[tree[0]] else tree[1]
    return tree


def boost(table: list[tuple[tuple[int, ...], int, int]], *, rounds: int, depth: int, rate: float) -> tuple[float, list]:
    """table: (features, candidates, personal ones). (first score, trees)."""
    n, known = sum(t[1] for t in table), sum(t[2] for t in table)
    first = math.log((known + 0.5) / (n - known + 0.5))
    scores, trees = [first] * len(table), []
    for _ in range(rounds):
        p = [1 / (1 + math.exp(-s)) for s in scores]
        tree = grow_tree([(f, c, k - c * q, c * q * (1 - q)) for (f, c, k), q in zip(table, p)], depth)
        trees.append(tree)
        scores = [s + rate * walk(tree, f) for s, (f, _, _) in zip(scores, table)]
    return first, trees


def total(model: tuple, f: tuple[int, ...], rate: float) -> float:
    return model[0] + rate * sum(walk(tree, f) for tree in model[1])


def least_score(rows: list[tuple[float, int, int]], precision: float) -> float:
    """rows: (score, candidates, personal ones). The least score from which on so many are personal; infinite if there is none."""
    out, n, known = math.inf, 0, 0
    for score in sorted({r[0] for r in rows}, reverse=True):
        n += sum(r[1] for r in rows if r[0] == score)
        known += sum(r[2] for r in rows if r[0] == score)
        if known >= precision * n:
            out = score
    return out


def fit(spark, *, rounds=30, depth=4, rate=0.3, precision=0.98) -> dict[int, tuple]:
    """For each kind (first score, trees, threshold, precision and recall on the sentences held out)."""
    taught = labelled_sentences(spark)
    found = candidates(taught).select("id", F.explode("loose").alias("c")).join(taught.select(F.col("doc_id").alias("id"), "kind", "start", "end", "label"), "id")
    own = (F.col("label") == 1) & (F.col("c.kind") == F.col("kind")) & (F.col("c.start") < F.col("end")) & (F.col("c.end") > F.col("start"))
    held = (F.pmod(F.xxhash64(F.lit("held"), "id"), F.lit(5)) == 0).alias("held")
    counts = found.groupBy(F.col("c.kind").alias("kind"), F.col("c.f").alias("f"), held).agg(F.count("*").alias("n"), F.count_if(own).alias("known"))
    tables: dict[tuple[int, bool], list] = {}
    for r in counts.collect():  # at most 8 * 2**len(FEATURES) rows
        tables.setdefault((r["kind"], r["held"]), []).append((tuple(r["f"]), r["n"], r["known"]))
    out = {}
    for kind in range(len(KINDS)):
        model = boost(sorted(tables[kind, False]), rounds=rounds, depth=depth, rate=rate)
        scored = [(round(total(model, f, rate), 9), n, known) for f, n, known in tables[kind, True]]
        least = least_score(scored, precision)
        n, known = (sum(r[k] for r in scored if r[0] >= least) for k in (1, 2))
        out[kind] = *model, least, known / max(1, n), known / max(1, sum(r[2] for r in scored))
    return out


def tree_column(tree, f: Column) -> Column:
    if not isinstance(tree, tuple):
        return F.lit(float(tree))
    return F.when(f[FEATURES[tree[0]]] == 1, tree_column(tree[2], f)).otherwise(tree_column(tree[1], f))


def chosen_ones(c: Column, model: dict[int, tuple], rate: float) -> Column:
    """Whether a candidate's score reaches its kind's threshold."""
    out = F.lit(False)
    for kind, (first, trees, least, *_) in model.items():
        score = F.lit(first)
        for tree in trees:
            score = score + F.lit(rate) * tree_column(tree, c["f"])
        if least < math.inf:
            out = F.when(c["kind"] == kind, score >= F.lit(least - 1e-6)).otherwise(out)
    return out


def redact_spans(docs: DataFrame, *, id_col="doc_id", text_col="text", rounds=30, depth=4, rate=0.3, precision=0.98) -> DataFrame:
    """(id, base, added): arrays of (kind, start, end), each by kind and start."""
    found = candidates(docs, id_col=id_col, text_col=text_col)
    model = fit(docs.sparkSession, rounds=rounds, depth=depth, rate=rate, precision=precision)
    bare = "array<struct<kind:int,start:int,end:int>>"
    keep = F.filter("loose", lambda c: ~c["base"] & ~F.exists("base", lambda b: (b["start"] < c["end"]) & (b["end"] > c["start"])))
    found = materialize(found.select("id", "base", keep.alias("loose")), "candidates")
    chosen = F.transform(F.filter("loose", lambda c: chosen_ones(c, model, rate)), lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end")))

    def apart(acc, c):
        return F.when(F.exists(acc, lambda b: (b["start"] < c["end"]) & (b["end"] > c["start"])), acc).otherwise(F.concat(acc, F.array(c)))

    return found.select("id", "base", F.aggregate(F.array_sort(chosen), F.array().cast(bare), apart).alias("added"))


def written(found: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, *, id_col="doc_id", text_col="text", **options) -> DataFrame:
    """docs with every span replaced by its kind in brackets; the ids must tell documents apart."""
    found = redact_spans(docs, id_col=id_col, text_col=text_col, **options).select(F.col("id").alias("__dk_id"), F.concat("base", "added").alias("__dk_spans"))
    joined = docs.join(found, docs[id_col].eqNullSafe(found.__dk_id))
    order = F.array_sort(F.transform("__dk_spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    names = F.array(*[F.lit(f"[{k}]") for k in KINDS])
    text = F.col(text_col)

    def step(acc, s):
        ahead = F.substr(text, acc["at"] + 1, F.greatest(F.lit(0), s["start"] - acc["at"]))
        put = F.when(s["start"] >= acc["at"], F.concat(acc["out"], ahead, F.get(names, s["kind"]))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), put.alias("out"))

    done = F.aggregate(order, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda a: F.concat(a["out"], F.substr(text, a["at"] + 1, F.length(text))))
    return joined.withColumn(text_col, F.when(F.size("__dk_spans") > 0, done).otherwise(text)).select(*docs.columns)
