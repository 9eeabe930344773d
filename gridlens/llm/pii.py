"""Personal data by weak supervision.

Exact patterns give the base spans, which always stay. Looser patterns propose further
candidates. On every candidate, base spans included, three labelers vote for, against or
not at all: a format rule, a gazetteer and the words before it. Expectation-maximisation
over the counts of vote patterns (at most 27 for each kind) estimates each labeler's
reliability; its posteriors are the soft labels of a naive Bayes span classifier over
votes, length and share of digits, which decides the loose candidates. All counts cover all
documents. DataFrame functions only; the driver handles tables of a few thousand rows.
"""

from __future__ import annotations

import math
from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

BASE = ("email", "ip", "card", "phone")
LOOSE = ("number", "local_phone", "secret")
#: The base patterns, anchored so that a search never starts inside a run it has already refused.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "number": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){11,18}+(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    "local_phone": r"(?<![0-9+(.-])(?<![0-9+)][ .-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9-])(?!\.[0-9])",
    "secret": r"(?<![A-Za-z0-9_-])(?=[A-Za-z_-]*+[0-9])(?=[0-9_-]*+[A-Za-z])[A-Za-z0-9_-]{24,128}+(?![A-Za-z0-9_-])",
}
#: A part of an address from 0 to 255.
OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
#: Words before a span that speak for its kind.
CONTEXTS = {
    "email": "e-?mails?|mail|contact|write|reach|to|from|kontakt|schreiben|courriel|correo",
    "ip": "ip|ipv4|host|hosts|server|address|addr|gateway|from|client|peer|adresse|rechner|serveur|servidor",
    "card": "card|visa|mastercard|amex|pay|paid|payment|credit|debit|account|number|karte|kreditkarte|carte|tarjeta",
    "phone": "tel|telephone|phone|call|calls|mobile|cell|fax|sms|whatsapp|telefon|mobil|anruf|portable|movil|llamar",
    "secret": "token|key|apikey|api_key|secret|password|passwd|pwd|auth|bearer|credential|sha1|sha256|passwort|clave",
}
#: Public registries, as far as they are long established: top-level domains; country calling codes (E.164); first digits of payment card issuers (ISO/IEC 7812).
DOMAINS = "com|org|net|edu|gov|mil|int|info|biz|name|pro|app|dev|io|ai|co|me|tv|eu|de|at|ch|fr|be|nl|lu|es|pt|it|uk|ie|us|ca|mx|br|ar|cl|pe|au|nz|jp|cn|kr|in|ru|ua|pl|cz|sk|hu|ro|bg|gr|tr|se|no|dk|fi|is|za|il|sg|hk|tw"
CALLING = "1|7|2[07]|2[1-689][0-9]|3[0-469]|3[578][0-9]|4[013-9]|42[0-9]|5[1-8]|5[09][0-9]|6[0-6]|6[789][0-9]|8[1246]|8[0578][0-9]|9[0-58]|9[679][0-9]"
ISSUERS = "4|5[1-5]|222[1-9]|22[3-9]|2[3-6]|27[01]|2720|3[47]|30[0-59]|3[689]|35|6011|64[4-9]|65|62|50|5[6-9]"
#: Format rule, gazetteer (patterns on the span) and words before it, by kind.
LABELERS = {
    "email": ("[A-Za-z]{2,24}$", rf"(?i)\.(?:{DOMAINS})$", CONTEXTS["email"]),
    "ip": (r"^[0-9]{1,3}\.", r"^(?!0|10\.|127\.|169\.254\.|172\.(?:1[6-9]|2[0-9]|3[01])\.|192\.168\.|22[4-9]\.|2[3-5][0-9]\.)", CONTEXTS["ip"]),
    "card": ("^[0-9]{16}$", f"^(?:{ISSUERS})", CONTEXTS["card"]),
    "phone": (r"^\+[0-9]{1,3} ?\(?[0-9]", rf"^\+(?:{CALLING})", CONTEXTS["phone"]),
    "number": ("^[0-9]{4}([ -])[0-9]{4}\\1[0-9]{4}\\1[0-9]{4}$", f"^(?:{ISSUERS})", CONTEXTS["card"]),
    "local_phone": (r"^\(?[2-9][0-9]{2}\)?.[2-9]", r"^\(?(?!555|800|888|877|866|900)[2-9][0-8][0-9]", CONTEXTS["phone"]),
    "secret": ("^(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64})$", "^(?:sk|pk|rk|gh[pousr]|glpat|AKIA|ASIA|AIza|eyJ|xox[abpr]|npm)|^[0-9a-f]{40}$", CONTEXTS["secret"]),
}
#: Characters of context before a span; matches located at a time.
CONTEXT, BLOCK = 24, 256
ROUNDS, CUTOFF = 50, 0.5
_SPAN = "STRUCT<s: INT, e: INT, m: STRING, c: STRING>"


def _q(pattern: str) -> str:
    return "r'" + pattern.replace("'", "\\x27") + "'"


def _located(pattern: str) -> str:
    """SQL array of (start, end, match, context before) of all matches in ``_text``, by code points.

    Text between matches and the matches themselves alternate, so positions are running
    sums; they are taken in blocks, which keeps texts with very many matches near linear.
    """
    p = _q(pattern)
    laid = f"""filter(zip_with(split(_text, {p}, -1), regexp_extract_all(_text, {p}, 0),
        (a, f) -> struct(length(a) AS a, length(a) + length(f) AS n, f AS m, right(a, {CONTEXT}) AS c)), x -> x.m IS NOT NULL)"""
    blocks = f"transform(array({laid}), z -> transform(sequence(0, greatest(0, size(z) - 1) DIV {BLOCK}), j -> slice(z, j * {BLOCK} + 1, {BLOCK})))[0]"
    offsets = """aggregate(bs, array(0), (o, b) -> concat(o, array(element_at(o, -1) + aggregate(b, 0, (t, x) -> t + x.n))))"""
    inner = f"""aggregate(b, struct(get(o, j) AS at, CAST(array() AS ARRAY<{_SPAN}>) AS got), (t, x) -> struct(t.at + x.n AS at,
        concat(t.got, array(struct(t.at + x.a AS s, t.at + x.n AS e, x.m AS m, x.c AS c))) AS got)).got"""
    whole = f"transform(array({blocks}), bs -> transform(array({offsets}), o -> flatten(transform(bs, (b, j) -> {inner})))[0])[0]"
    return f"CASE WHEN _text RLIKE {p} THEN {whole} ELSE CAST(array() AS ARRAY<{_SPAN}>) END"


_DIGITS = "regexp_replace(x.m, '[^0-9]+', '')"
_LUHN = """aggregate(transform(sequence(1, length(d)), i -> CAST(substr(d, -i, 1) AS INT) * (2 - i % 2)),
    0, (t, v) -> t + v - CASE WHEN v > 9 THEN 9 ELSE 0 END) % 10 = 0"""
_IS_CARD = f"transform(array({_DIGITS}), d -> length(d) BETWEEN 16 AND 19 AND {_LUHN})[0]"


def candidates(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """_id, _text and, for each kind, an array of spans (s, e, m, c)."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    own = docs.select(F.col(id_col).alias("_id"), text.alias("_text"))
    own = own.withColumns({k: F.expr(_located(p)) for k, p in PATTERNS.items()})
    keep = {
        "email": F.col("email"),
        "ip": F.expr(f"filter(ip, x -> x.m RLIKE '^{OCTET}([.]{OCTET}){{3}}$')"),
        "card": F.expr(f"filter(number, x -> {_IS_CARD})"),
        "phone": F.expr(f"filter(phone, x -> length({_DIGITS}) BETWEEN 8 AND 15)"),
        "number": F.expr(f"filter(number, x -> NOT {_IS_CARD})"),
        "local_phone": F.col("local_phone"),
        "secret": F.col("secret"),
    }
    return own.select("_id", "_text", *[v.alias(k) for k, v in keep.items()])


def _described(kind: str) -> Column:
    """Spans with their votes (-1, 0, 1 as digits 0 to 2) and features in place of their texts."""
    form, names, words = LABELERS[kind]
    form, names, before = map(_q, (form, names, rf"(?i)(?<![a-z])(?:{words})\W*$"))
    votes = f"""concat(CASE WHEN x.m RLIKE {form} THEN '2' ELSE '0' END, CASE WHEN x.m RLIKE {names} THEN '2' ELSE '0' END,
        CASE WHEN x.c RLIKE {before} THEN '2' WHEN length(x.c) < 4 THEN '1' ELSE '0' END)"""
    return F.expr(f"""transform({kind}, x -> struct(x.s AS s, x.e AS e, {votes} AS v,
        CAST(least(7, (x.e - x.s) DIV 6) AS INT) AS n, CAST(length({_DIGITS}) * 4 DIV (x.e - x.s) AS INT) AS d))""").alias(kind)


def _odds(votes: str, seen: dict) -> float:
    """Log odds of personal data from votes; an abstention says nothing."""
    out = 0.0
    for i, x in enumerate(votes):
        if x != "1":
            of = [seen[c, i, x] / (seen[c, i, "0"] + seen[c, i, "2"]) for c in (0, 1)]
            out += math.log(of[1]) - math.log(of[0])
    return out


def _tallied(rows, post) -> dict:
    """Expected votes of each labeler in either class, on a start that favours votes for in one and against in the other."""
    seen = {(c, i, x): 2.0 if (x == "2") == bool(c) else 1.0 for c in (0, 1) for i in range(3) for x in "02"}
    for kind, votes, n in rows:
        for i, x in enumerate(votes):
            if x != "1":
                seen[1, i, x] += n * post[kind, votes]
                seen[0, i, x] += n * (1 - post[kind, votes])
    return seen


def _posterior(odds: float) -> float:
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))


def reliabilities(counts: dict[tuple[str, str], int]) -> dict[tuple[str, str], float]:
    """Posterior that a candidate is personal data, by (kind, votes), from two-class expectation-maximisation.

    Reliabilities are a labeler's vote distribution in either class, shared by all kinds; the
    prior is by kind. Base kinds enter as known positives.
    """
    post = {k: 1.0 if k[0] in BASE else sum(map(int, k[1])) / (2 * len(k[1])) for k in counts}
    for _ in range(ROUNDS):
        seen = _tallied([(k, v, n) for (k, v), n in counts.items()], post)
        good, every = defaultdict(lambda: 1.0), defaultdict(lambda: 2.0)
        for (kind, v), n in counts.items():
            good[kind] += n * post[kind, v]
            every[kind] += n
        post |= {(k, v): _posterior(math.log(good[k] / (every[k] - good[k])) + _odds(v, seen)) for k, v in counts if k not in BASE}
    return post


def classifier(rows: list[tuple[str, str, int, int, int]]) -> dict[tuple[str, str, int, int], bool]:
    """Decision for each (kind, votes, length, digits) seen: naive Bayes on the posteriors as soft labels."""
    counts: dict[tuple[str, str], int] = defaultdict(int)
    for kind, v, _, _, n in rows:
        counts[kind, v] += n
    post = reliabilities(counts)
    seen = _tallied([(k, v, n) for (k, v), n in counts.items()], post)
    total, shape = defaultdict(lambda: 2.0), defaultdict(lambda: 1.0)
    for kind, v, length, digits, n in rows:
        for c, w in ((0, n * (1 - post[kind, v])), (1, n * post[kind, v])):
            total[c, kind] += w
            shape[c, kind, "n", length] += w
            shape[c, kind, "d", digits] += w
    out = {}
    for kind, v, length, digits, _ in rows:
        odds = math.log(total[1, kind] / total[0, kind]) + _odds(v, seen)
        for f in (("n", length), ("d", digits)):
            odds += math.log(shape[1, kind, *f] / total[1, kind]) - math.log(shape[0, kind, *f] / total[0, kind])
        out[kind, v, length, digits] = _posterior(odds) >= CUTOFF
    return out


def _decided(described: DataFrame) -> dict[str, list[str]]:
    """For each loose kind the (votes, length, digits) that count as personal data, from the candidates of all documents."""
    each = F.explode(F.concat(*[F.expr(f"transform({k}, x -> struct('{k}' AS k, x.v AS v, x.n AS n, x.d AS d))") for k in (*BASE, *LOOSE)]))
    rows = described.select(each.alias("x")).groupBy("x.k", "x.v", "x.n", "x.d").agg(F.count(F.lit(1))).collect()  # kinds x 27 x 8 x 5 at most
    out: dict[str, list[str]] = {k: [] for k in LOOSE}
    for (kind, v, n, d), good in sorted(classifier(sorted(map(tuple, rows))).items()):
        if good and kind in out:
            out[kind].append(f"{v}{n}{d}")
    return out


def _chosen(decided: dict[str, list[str]]) -> list[Column]:
    """Each kind's spans as arrays of (s, e)."""
    out = [F.expr(f"transform({k}, x -> struct(x.s AS s, x.e AS e))").alias(k) for k in BASE]
    for k, names in decided.items():
        listed = ", ".join(f"'{x}'" for x in names) or "''"
        out.append(F.expr(f"transform(filter({k}, x -> concat(x.v, x.n, x.d) IN ({listed})), x -> struct(x.s AS s, x.e AS e))").alias(k))
    return out


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id_col and, for each kind, its spans as an array of (s, e), sorted, end exclusive.

    Null texts are empty and have no spans. Repeated rows are searched each for itself; the
    labelers count them all. An empty table gives no rows. Other columns are ignored.
    """
    own = common.cut(candidates(docs, id_col, text_col).select("_id", *[_described(k) for k in (*BASE, *LOOSE)]))
    return own.select(F.col("_id").alias(id_col), *_chosen(_decided(own)))


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with each span found replaced by its kind in angle brackets; of overlapping spans the first names all.

    Null texts stay null, other columns as they are.
    """
    kinds = (*BASE, *LOOSE)
    rows = docs.select(F.struct("*").alias("_row"), F.col(text_col).alias("_t"))
    described = candidates(rows, "_row", "_t").select("_id", "_text", *[_described(k) for k in kinds])
    decided = _decided(described.drop("_id", "_text"))
    every = F.sort_array(F.concat(*[F.expr(f"transform({k}, x -> struct(x.s AS s, x.e AS e, '{k}' AS k))") for k in kinds])).alias("_all")
    found = described.select("_id", "_text", *_chosen(decided)).select("_id", "_text", every)
    told = """aggregate(_all, struct(0 AS at, CAST(array() AS ARRAY<STRING>) AS got), (t, x) -> CASE WHEN x.e <= t.at THEN t ELSE struct(x.e AS at,
        concat(t.got, array(concat(substr(_text, t.at + 1, greatest(0, x.s - t.at)), CASE WHEN x.s < t.at THEN '' ELSE concat('<', x.k, '>') END))) AS got) END)"""
    found = found.withColumn("_told", F.expr(told))
    left = F.when(F.size("_all") > 0, F.concat(F.array_join("_told.got", ""), F.expr("substr(_text, _told.at + 1)"))).otherwise(F.col("_text"))
    text = F.when(F.col("_id").getField(text_col).isNotNull(), left)
    return found.select(*[text.alias(c) if c == text_col else F.col("_id").getField(c).alias(c) for c in docs.columns])


def _told(kinds: list[str]) -> Column:
    each = [F.expr(f"transform({k}, x -> concat('{k}:', x.s, ':', x.e))") for k in kinds]
    return F.array_join(F.concat(*each), ",")


def op7_pii(spark, sf_dir: str) -> DataFrame:
    found = find(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in BASE]
    return found.select("doc_id", *counts, F.sha2(_told(list(BASE)).cast("binary"), 256).alias("base_sha256"), _told([*BASE, *LOOSE]).alias("spans"))
