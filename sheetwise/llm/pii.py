"""Personal data by candidate gradient boosting.

1. Generators of high recall propose overlapping spans on the whole text: the base
   kinds (email, ip, card, phone), looser forms of them, such as numbers without
   a plus sign, national ones that begin with 0, addresses spelled with "at" and
   "dot", hosts after an @ without a dot, ip addresses with their dots in brackets and
   of version 6, and three more kinds: bank accounts (iban), dashed identity numbers
   (id) and keys or tokens (secret).
2. Every candidate gets format features (lengths, digits, separators, checksum,
   kind) and context features (cue words and marks just before and behind it).
3. Boosted regression trees score it. They are fitted when the module is first used,
   on `examples()`, a fixed and bounded set of labelled contexts written out by
   rule, and compiled into one CASE expression for each tree.
4. Per kind, the threshold is the least score whose precision on held-out examples
   reaches `PRECISION`. Candidates at or above it are redacted.

Base spans are found by exact rules and stay whatever their score; the model adds
spans that do not overlap them. Everything that touches a document is a DataFrame
expression: positions come from the lengths of the parts between the matches.

Defined results: a null or empty text has no span; positions are code points, ends
exclusive; matches of one kind never overlap, spans of different kinds may; rows are
judged one by one, so repeated rows and null ids are kept; texts of any length are
searched whole, and redaction copies a text once for each of its spans; other columns
pass through `redact` untouched, whatever their names, and through `spans`, which
replaces columns named pii_base and pii_added.
"""

from __future__ import annotations

import random
from functools import lru_cache, reduce
from operator import or_

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "id", "secret")
_LOCAL = "A-Za-z0-9._%+-"
#: Java patterns of the base kinds. Possessive repeats and the look-behind (or the end of the last match) only spare
#: retries inside a run that has failed already: the matches are those of the plain patterns, in linear time.
BASE = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
#: Looser generators, each with the kind it proposes.
LOOSE = {
    "email_spelled": ("email", r"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]{1,64}+(?: ?[\[(]at[\])] ?| at )[a-z0-9-]{1,63}+(?:(?: ?[\[(]dot[\])] ?| dot )[a-z0-9-]{1,63}+)++"),
    "email_host": ("email", r"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]{1,64}+@[a-z0-9-]{1,63}+(?![@a-z0-9-]|\.[a-z0-9-])"),
    "ip_bracketed": ("ip", rf"(?i)(?<![0-9.]){_OCTET}(?: ?[\[(](?:dot|\.)[\])] ?{_OCTET}){{3}}(?![0-9])"),
    "phone_plain": ("phone", r"(?<![0-9.+-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9-])"),
    "phone_digits": ("phone", r"(?<![0-9A-Za-z.+-])[0-9]{9,15}+(?![A-Za-z-]|[. ][0-9])"),
    "phone_national": ("phone", r"(?<![0-9.+-])0[0-9]{2,4}[ .-][0-9]{3,4}[ .-]?[0-9]{3,4}(?![0-9-]|[ .][0-9])"),
    "ip_version6": ("ip", r"(?i)(?<![0-9a-z:.])(?:(?:[0-9a-f]{1,4}:){7}[0-9a-f]{1,4}|(?:[0-9a-f]{1,4}:){1,6}(?::[0-9a-f]{1,4}){1,6})(?![0-9a-z:.])"),
    "iban": ("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
    "id_dashed": ("id", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    "secret": ("secret", r"(?<![A-Za-z0-9_-])(?=[A-Za-z_-]*[0-9])[A-Za-z0-9_-]{20,128}+(?![A-Za-z0-9_-])"),
}
#: What a text must hold for a generator to match, any of these; looked for first, as that is quick.
NEEDS = {"email_host": ("@",), "ip_bracketed": ("[", "("), "ip_version6": (":",)}
PRECISION = 0.98
TREES, DEPTH, RATE = 40, 3, 0.3
CUES = {
    "cue_phone": "phone|tel|call|mobile|fax|cell|whatsapp|dial|reach|my number",
    "cue_mail": "mail|contact|write|address",
    "cue_id": "ssn|social|security|passport|identity|card|account",
    "cue_host": r"\bip|\bhost|server|\bping|login|\bnode",
    "cue_secret": "token|secret|api key|key|password|passwd|credential|bearer",
    "cue_bank": "iban|account|bank|transfer|pay",
    "cue_other": "commit|digest|checksum|hash|order|invoice|version|isbn|part|model|page|item|figure|table|section",
}
#: Last labels that tell an address.
ENDS = "com|org|net|edu|gov|info|io|eu|uk|us|ca|de|fr|es|it|nl|ch|at|se|pl|ru|cn|jp|in|br|au"
FEATURES = ("k_email", "k_phone", "k_iban", "k_id", "k_ip", "k_secret", "at_sign", "known_end", "n_chars", "n_digits", "n_marks", "n_upper", "parens", "colons", "checksum", "distinct", *CUES, "hash_before", "word_after")


def find(df: DataFrame, name: str, text: str, pattern: str, needs: tuple[str, ...] = ()) -> DataFrame:
    """Adds column `name`: array<(s, e, m)> of all matches of the pattern in the text column.

    Most texts have no match; they are told apart by one search before the other work.
    """
    likely = reduce(or_, [F.contains(F.col(text), F.lit(n)) for n in needs]) if needs else F.lit(True)
    found = F.when(likely & F.rlike(text, F.lit(pattern)), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(F.array().cast("array<string>"))
    df = df.withColumn("_m", found)
    df = df.withColumn("_g", F.when(F.size("_m") > 0, F.transform(F.split(text, pattern, -1), lambda g: F.length(g))).otherwise(F.array().cast("array<int>")))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<s:int,e:int,m:string>>").alias("out"))

    def place(state: Column, i: Column) -> Column:
        s = state["at"] + F.get("_g", i)
        m = F.get("_m", i)
        return F.struct((s + F.length(m)).alias("at"), F.concat(state["out"], F.array(F.struct(s.alias("s"), (s + F.length(m)).alias("e"), m.alias("m")))).alias("out"))

    walked = F.aggregate(F.sequence(F.lit(0), F.size("_m") - 1), zero, place, lambda st: st["out"])
    return df.withColumn(name, F.when(F.size("_m") > 0, walked).otherwise(zero["out"])).drop("_m", "_g")


def luhn(digits: Column) -> Column:
    """The Luhn test of a string of digits."""
    n = F.length(digits)

    def weigh(total: Column, i: Column) -> Column:
        d = F.substring(digits, n - i, F.lit(1))
        doubled = F.translate(d, "0123456789", "0246813579")
        return total + F.when(i % 2 == 1, doubled).otherwise(d).cast("int")

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), weigh) % 10 == 0


def mod97(account: Column) -> Column:
    """The check of a bank account number: its first four characters moved to the end, letters read as 10 to 35, leave 1 modulo 97."""
    plain = F.upper(F.replace(account, F.lit(" "), F.lit("")))
    turned = F.concat(F.substring(plain, F.lit(5), F.length(plain)), F.substring(plain, F.lit(1), F.lit(4)))

    def step(left: Column, i: Column) -> Column:
        value = F.instr(F.lit("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"), F.substring(turned, i, F.lit(1))) - 1
        return F.when(value > 9, left * 100 + value).otherwise(left * 10 + value) % 97

    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), step) == 1


def valid(kind: str, m: Column) -> Column:
    """Whether a match of a base pattern counts."""
    digits = F.regexp_replace(m, "[^0-9]", "")
    if kind == "ip":
        part = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
        return F.rlike(m, F.lit(rf"^{part}(?:\.{part}){{3}}$"))
    if kind == "card":
        return F.length(digits).between(13, 19) & luhn(F.when(F.length(digits).between(13, 19), digits).otherwise("0"))
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def features(m: Column, before: Column, after: Column, kind: Column) -> list[Column]:
    """The features of a candidate, in the order of FEATURES, as doubles."""
    digits = F.regexp_replace(m, "[^0-9]", "")
    cue = lambda words: F.rlike(F.lower(before), F.lit(f"(?:{words})[^a-z]*(?:(?:is|at|to|me|us|no|number)[^a-z]+){{0,3}}$"))
    each = [kind == "email", kind == "phone", kind == "iban", kind == "id", kind == "ip", kind == "secret", F.contains(m, F.lit("@")), F.rlike(F.lower(m), F.lit(f"[^a-z0-9-](?:{ENDS})$")), F.length(m), F.length(digits), F.length(F.regexp_replace(m, "[A-Za-z0-9]", "")), F.length(F.regexp_replace(m, "[^A-Z]", "")), F.rlike(m, F.lit(r"[(\[]"))]
    each += [F.contains(m, F.lit(":")), F.when(kind == "iban", mod97(m)).otherwise(False), F.size(F.array_distinct(F.split(F.lower(m), "")))] + [cue(w) for w in CUES.values()]
    each += [F.rlike(before, F.lit(r"[#$€£=:/-] ?$")), F.rlike(after, F.lit("^ ?[A-Za-z]"))]
    return [c.cast("double") for c in each]


def examples(n: int = 4000, seed: int = 11) -> list[tuple[str, str, str, str, int]]:
    """(before, match, after, kind, label): contexts written by rule, half of them personal data."""
    r = random.Random(seed)
    num = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    word = lambda: "".join(r.choice("abcdefghilmnoprstu") for _ in range(r.randrange(2, 9)))
    out = []
    for _ in range(n):
        kind, good = r.choice(("email", "phone", "iban", "id", "ip", "secret")), r.random() < 0.5
        lead = word() + " " + word() + " "
        other = ["order ", "version ", "item ", "page ", "table ", word() + " ", word() + ", ", word() + ": "]
        if kind == "email":
            # forms are the same on both sides, with and without digits, spaces and brackets; the cue and the last label tell
            mail = ["mail me at ", "mail ", "contact: ", "contact me at ", "write to ", "email ", "my email is ", "address: "]
            local = r.choice([word(), f"{word()}{r.choice('._-')}{word()}", f"{word()}{r.choice(['.', '_', ''])}{num(r.randrange(1, 5))}"])
            if r.random() < 0.25:
                match = f"{local}@{word()}{r.choice(['', '-' + word(), num(2)])}"
                cue = mail if good else other
            else:
                known = good or r.random() < 0.2
                labels = [word() + r.choice(["", num(2)])] + [word()] * (r.random() < 0.3) + [r.choice(ENDS.split("|")) if known else word() + "x"]
                at, dot = r.choice([("[at]", "[dot]"), (" [at] ", " [dot] "), ("(at)", "(dot)"), (" (at) ", " (dot) "), (" at ", " dot ")])
                match = local + at + dot.join(labels)
                cue = (mail + [word() + " "] * 5 if good else other[:5] if known else other + mail[:3])
            before = lead + r.choice(cue)
        elif kind == "ip":
            match = r.choice(["[.]", "(.)", "[dot]", "(dot)", " [dot] ", " (dot) "]).join(str(r.randrange(256)) for _ in range(4))
            if r.random() < 0.4:
                group = lambda: f"{r.randrange(1 << r.choice([4, 12, 16])):x}"
                match = r.choice([":".join(group() for _ in range(8)), f"{':'.join(group() for _ in range(r.randrange(1, 4)))}::{':'.join(group() for _ in range(r.randrange(1, 4)))}"])
            before = lead + r.choice(["ip ", "ip: ", "host ", "server ", "ping ", "login at ", "node is ", word() + " "] if good else other[:5] + ["section ", "figure "])
        elif kind == "phone":
            match = r.choice([f"({num(3)}) {num(3)}-{num(4)}", f"{num(3)}-{num(3)}-{num(4)}", f"{num(3)}.{num(3)}.{num(4)}", f"{num(3)} {num(3)} {num(4)}", num(r.choice([9, 10, 10, 11, 12])), f"0{num(2)} {num(4)} {num(4)}", f"0{num(3)} {num(3)} {num(4)}", f"0{num(2)}-{num(4)}{num(3)}"])
            cue = ["call ", "call me at ", "tel: ", "phone ", "phone number ", "mobile: ", "fax ", "cell is ", "my number is ", "my number: ", "reach me at ", "dial "] if good else ["order ", "invoice no ", "version ", "isbn ", "part number ", "item #", "table ", word() + " ", word() + ": $"]
            before = lead + r.choice(cue)
        elif kind == "iban":
            # both sides have the form; the checksum tells, and rarely the cue alone
            body = "".join(r.choice("0123456789" * 3 + "ABCDEFGHJKLMNPQRSTUVWXYZ") for _ in range(r.randrange(11, 27)))
            land = r.choice(["DE", "GB", "FR", "NL", "ES", "IT", "CH", "AT", "BE", "PL"])
            code = 98 - int("".join(str(int(c, 36)) for c in body + land)) % 97 * 100 % 97
            plain = f"{land}{code if good else (code + r.randrange(1, 90)) % 97:02d}{body}"
            match = plain if r.random() < 0.5 else " ".join(plain[i : i + 4] for i in range(0, len(plain), 4))
            before = lead + r.choice(["iban ", "iban: ", "account ", "pay to ", "transfer to ", word() + " "] if good else ["order ", "part number ", "model ", "account ", word() + " "])
        elif kind == "secret":
            letters = r.choice(["0123456789abcdef", "0123456789ABCDEF", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"])
            match = r.choice(["", "", "sk-", "ghp_", "AKIA"]) + num(1) + "".join(r.choice(letters) for _ in range(r.randrange(19, 60)))
            cue = ["token = ", "token: ", 'token = "', 'secret = "', "api key ", "api_key=", "password is ", "password: ", "bearer ", "key: "]
            before = lead + r.choice(cue if good else ["commit ", "digest ", "checksum ", "hash ", "order ", "page ", word() + " ", word() + "/", word() + ": "])
        else:
            match = f"{num(3)}-{num(2)}-{num(4)}"
            cue = ["ssn ", "social security number ", "ssn: ", "passport ", "identity no "] if good else ["order ", "part ", "model ", "invoice ", word() + " ", "item #", "section "]
            before = lead + r.choice(cue)
        out.append((before[-24:], match, " " + word(), kind, int(good)))
    return out


def _grow(x: np.ndarray, g: np.ndarray, depth: int):
    """A regression tree on residuals: a leaf value, or (feature, threshold, left, right)."""
    best = None
    if depth and len(g) >= 20:
        base = g.sum() ** 2 / len(g)
        for f in range(x.shape[1]):
            for t in np.unique(np.quantile(x[:, f], np.linspace(0.05, 0.95, 12))):
                left = x[:, f] <= t
                k = int(left.sum())
                if 10 <= k <= len(g) - 10:
                    gain = g[left].sum() ** 2 / k + g[~left].sum() ** 2 / (len(g) - k) - base
                    if gain > 1e-6 and (best is None or gain > best[0]):
                        best = (gain, f, float(t), left)
    if best is None:
        return float(g.mean()) if len(g) else 0.0
    _, f, t, left = best
    return f, t, _grow(x[left], g[left], depth - 1), _grow(x[~left], g[~left], depth - 1)


def _apply(tree, x: np.ndarray) -> np.ndarray:
    if isinstance(tree, float):
        return np.full(len(x), tree)
    f, t, a, b = tree
    return np.where(x[:, f] <= t, _apply(a, x), _apply(b, x))


def boost(x: np.ndarray, y: np.ndarray) -> list:
    """Trees for the log odds of y, each fitted to the residuals of those before it."""
    score, trees = np.zeros(len(y)), []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-score))
        tree = _grow(x, 4 * (y - p), DEPTH)
        trees.append(tree)
        score += RATE * _apply(tree, x)
    return trees


def calibrate(score: np.ndarray, y: np.ndarray) -> float:
    """The least score from which on the precision is PRECISION."""
    order = np.argsort(-score, kind="stable")
    good = np.cumsum(y[order]) / np.arange(1, len(y) + 1)
    last = np.append(score[order][1:] != score[order][:-1], True)
    ok = np.flatnonzero(last & (good >= PRECISION))
    return float(score[order][ok[-1]]) if len(ok) else float("inf")


@lru_cache(maxsize=1)
def _model(app: str) -> tuple[list, dict[str, float]]:
    """Trees and thresholds by kind; fitted once an application on half of the examples, calibrated on the other half."""
    spark = SparkSession.getActiveSession()
    rows = examples()
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, b string, m string, a string, k string, y int")
    got = sorted(df.select("i", "y", F.array(*features(F.col("m"), F.col("b"), F.col("a"), F.col("k"))).alias("x"), "k").collect())
    x, y, k = np.array([r.x for r in got]), np.array([r.y for r in got], float), np.array([r.k for r in got])
    half = np.arange(len(y)) % 2 == 0
    trees = boost(x[half], y[half])
    score = sum(RATE * _apply(t, x) for t in trees)
    return trees, {kind: calibrate(score[~half & (k == kind)], y[~half & (k == kind)]) for kind in KINDS}


def _tree_sql(tree) -> str:
    if isinstance(tree, float):
        return f"{tree!r}D"
    f, t, a, b = tree
    return f"CASE WHEN x[{f}] <= {t!r}D THEN {_tree_sql(a)} ELSE {_tree_sql(b)} END"


def spans(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with `pii_base` and `pii_added`: array<(kind, s, e)>, base ones by kind as listed and start."""
    spark = docs.sparkSession
    trees, thresholds = _model(spark.sparkContext.applicationId)
    # the caller's columns travel in one, so that no name of theirs meets those below
    out = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("pii_base", "pii_added")]).alias("_row"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("_t"))
    typed = "array<struct<kind:string,s:int,e:int>>"
    for kind, pattern in BASE.items():
        out = find(out, f"_b_{kind}", "_t", pattern)
        good = F.transform(F.filter(f"_b_{kind}", _validator(kind)), _tagger(kind))
        out = out.withColumn(f"_b_{kind}", good.cast(typed))
    out = out.withColumn("pii_base", F.concat(*[f"_b_{k}" for k in BASE])).drop(*[f"_b_{k}" for k in BASE])
    score = " + ".join(f"{RATE}D * ({_tree_sql(t)})" for t in trees)
    added = F.array().cast(typed)
    for name, (kind, pattern) in LOOSE.items():
        out = find(out, f"_l_{name}", "_t", pattern, NEEDS.get(name, ()))
        out = out.withColumn(f"_x_{name}", F.transform(f"_l_{name}", _featured(kind)))
        judged = F.expr(f"filter(_x_{name}, c -> (transform(array(c.x), x -> {score})[0]) >= {thresholds[kind]!r}D)" if np.isfinite(thresholds[kind]) else f"filter(_x_{name}, c -> false)")
        out = out.withColumn(f"_j_{name}", F.transform(judged, lambda c: F.struct(c["kind"].alias("kind"), c["s"].alias("s"), c["e"].alias("e"))).cast(typed))
        same = [F.col(f"_j_{n}") for n in list(LOOSE)[: list(LOOSE).index(name)] if LOOSE[n][0] == kind]
        added = F.concat(added, F.filter(f"_j_{name}", _apart(same)) if same else F.col(f"_j_{name}"))
    out = out.withColumn("_added", added)
    free = lambda c: ~F.exists("pii_base", lambda b: (b["s"] < c["e"]) & (c["s"] < b["e"]))
    return out.select("_row.*", "pii_base", F.filter("_added", free).alias("pii_added"))


def _validator(kind: str):
    return lambda c: valid(kind, c["m"])


def _apart(others: list[Column]):
    """Whether a span meets none of the spans of the other columns."""
    return lambda c: ~F.exists(F.concat(*others), lambda b: (b["s"] < c["e"]) & (c["s"] < b["e"]))


def _tagger(kind: str):
    return lambda c: F.struct(F.lit(kind).alias("kind"), c["s"].alias("s"), c["e"].alias("e"))


def _featured(kind: str):
    def make(c: Column) -> Column:
        low = F.greatest(F.lit(0), c["s"] - 24)
        before = F.substring(F.col("_t"), low + 1, c["s"] - low)
        after = F.substring(F.col("_t"), c["e"] + 1, F.lit(2))
        return F.struct(F.lit(kind).alias("kind"), c["s"].alias("s"), c["e"].alias("e"), F.array(*features(c["m"], before, after, F.lit(kind))).alias("x"))

    return make


def ordered(all_spans: Column) -> Column:
    """Spans by kind as listed, then start."""
    rank = F.create_map(*[F.lit(x) for i, k in enumerate(KINDS) for x in (k, i)])
    keyed = F.array_sort(F.transform(all_spans, lambda c: F.struct(F.element_at(rank, c["kind"]).alias("r"), c["s"].alias("s"), c["e"].alias("e"), c["kind"].alias("kind"))))
    return F.transform(keyed, lambda c: F.concat_ws(":", c["kind"], c["s"].cast("string"), c["e"].cast("string")))


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with every found span replaced by its kind in brackets; overlapping spans become one, named by the first."""
    names = docs.columns
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col(f"`{text_col}`").cast("string").alias("text"))
    found = spans(packed).withColumn("all", F.array_sort(F.transform(F.concat("pii_base", "pii_added"), lambda c: F.struct(c["s"].alias("s"), (-c["e"]).alias("b"), c["kind"].alias("kind")))))
    text = F.coalesce(F.col("text"), F.lit(""))
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(st: Column, c: Column) -> Column:
        fresh = F.concat(st["out"], F.substring(text, st["at"] + 1, c["s"] - st["at"]), F.lit("["), F.upper(c["kind"]), F.lit("]"))
        return F.struct(F.greatest(st["at"], -c["b"]).alias("at"), F.when(c["s"] >= st["at"], fresh).otherwise(st["out"]).alias("out"))

    whole = F.aggregate("all", zero, step, lambda st: F.concat(st["out"], F.substring(text, st["at"] + 1, F.length(text))))
    clean = F.when(F.size("all") > 0, whole).otherwise(F.col("text"))
    return found.select(*[clean.alias(c) if c == text_col else F.col("row")[c].alias(c) for c in names])


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda k: F.size(F.filter("pii_base", lambda c: c["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select(
        "doc_id",
        *[count(k) for k in BASE_KINDS],
        F.sha2(F.array_join(ordered(F.col("pii_base")), ","), 256).alias("base_sha256"),
        F.array_join(ordered(F.concat("pii_base", "pii_added")), ",").alias("spans"),
    )
