"""Personal data: patterns propose spans, checksums confirm them, context words weigh them.

Emails, addresses, cards and phones are the base kinds and always stay. IBANs (mod-97) and
social security numbers are added where their score, a start value moved by words in the 40
characters before the span, reaches ``least``. An IBAN has its country's length, so what
follows it can't spoil it. DataFrame functions only: matches and the
gaps between them come from regular expressions, places are running sums over their lengths
(in blocks of 256, so that a text with very many matches costs little more than a short one).
The 40 characters before a span come from its gap and the matches and gaps before that.

The base patterns use possessive repeats, which here match the same text as plain ones and need
no stack, and may not start inside a run that they would have taken from its beginning.

Defined results: a null or empty text has no spans, the digest of an empty string and score
0; repeated rows give equal rows; an empty table gives no rows; columns besides doc_id and
text are not read. Places count code points.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidebar.llm.base import texts

# Kinds in order, with a cheap first look, the pattern, and the test of a
# match ``s``.
_PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"
BASE_KINDS = {
    "email": ("contains(text, '@')",
              r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "true"),
    "ip": (None, r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", f"s rlike '^{_PART}(?:[.]{_PART}){{3}}$'"),
    "card": (None, r"[0-9](?:[\x20-]?[0-9]){15,}+", "length({digits}) <= 19 and {luhn}"),
    "phone": ("contains(text, '+')", r"\+[0-9][\x20().0-9-]+[0-9]", "length({digits}) between 8 and 15"),
}
# The length of an IBAN by country.
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "BY": 28, "CH": 21,
    "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FO": 18, "FR": 27,
    "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26,
    "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "LY": 25, "MC": 27,
    "MD": 24, "ME": 22, "MK": 19, "MR": 27, "MT": 31, "MU": 30, "NL": 18, "NO": 15, "PK": 24, "PL": 28, "PS": 29, "PT": 25,
    "QA": 29, "RO": 24, "RS": 22, "SA": 24, "SC": 31, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "ST": 25, "SV": 28, "TL": 23,
    "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20,
}


def _iban_pattern() -> str:
    by_length: dict[int, list[str]] = {}
    for country, length in IBAN_LENGTHS.items():
        by_length.setdefault(length, []).append(country)
    each = (rf"(?:{'|'.join(c)})[0-9]{{2}}(?:\x20?[A-Z0-9]){{{n - 4}}}" for n, c in sorted(by_length.items()))
    return rf"(?<![A-Za-z0-9])(?:{'|'.join(each)})(?![A-Za-z0-9])"


MORE_KINDS = {
    "iban": (None, _iban_pattern(), "{mod97}"),
    "ssn": (None, r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
            "substr(s, 1, 3) not in ('000', '666') and substr(s, 5, 2) <> '00' and substr(s, 8, 4) <> '0000'"),
}
# The score of a confirmed match, words that raise it by 0.3, and that lower it by 0.3.
SCORES = {
    "email": (0.9, "mail|contact|write", "example"),
    "ip": (0.5, "ip|address|host|server", "version|release|section"),
    "card": (0.7, "card|visa|master|amex|credit|debit|pay", "order|tracking|isbn|serial"),
    "phone": (0.6, "phone|tel|call|mobile|fax|contact", "version|order"),
    "iban": (0.8, "iban|account|bank", "order|serial"),
    "ssn": (0.4, "ssn|social|security|tax", "order|part|serial"),
}
CONTEXT, BLOCK = 40, 256
SHORTEST = 5  # characters of the shortest match of any kind

_DIGITS = r"regexp_replace(s, '[^0-9]', '')"
_LUHN = (
    "aggregate(transform(sequence(1, length({d})), i -> int(substr({d}, -i, 1)) * if(i % 2 = 0, 2, 1)), "
    "0, (a, x) -> a + if(x > 9, x - 9, x)) % 10 = 0"
).format(d=_DIGITS)
_COMPACT = r"replace(s, ' ', '')"
# letters count 10 to 35, so a letter moves two places; the first four characters go last
_MOD97 = (
    "aggregate(split(concat(substr({c}, 5), substr({c}, 1, 4)), ''), 0, (a, c) -> "
    "if(c between '0' and '9', (a * 10 + int(c)) % 97, if(c = '', a, (a * 100 + ascii(c) - 55) % 97))) = 1"
).format(c=_COMPACT)


def _quoted(pattern: str) -> str:
    return "r'" + pattern + "'"


def _steps() -> str:
    """Each match with its length, the length of the gap before it, and the characters before it.

    ``before`` is the end of the gaps and matches that go before; as a match has at least
    ``SHORTEST`` characters, CONTEXT / SHORTEST of them are enough.
    """
    near = CONTEXT // SHORTEST
    earlier = f"array_join(slice(tails, greatest(i - {near}, 0) + 1, least(i, {near})), '')"
    return (f"transform(found, (m, i) -> named_struct('skip', length(get(gaps, i)), 'size', length(m), "
            f"'before', lower(right(concat({earlier}, right(get(gaps, i), {CONTEXT})), {CONTEXT})), 's', m))")


def _placed(steps: str) -> str:
    """Steps with start and end: running sums inside blocks, from the sums of whole blocks."""
    spans = "array<struct<start:int,stop:int,before:string,s:string>>"
    one = "array(named_struct('start', a.pos + x.skip, 'stop', a.pos + x.skip + x.size, 'before', x.before, 's', x.s))"
    inner = (f"aggregate(b, named_struct('pos', get(offsets, i), 'out', cast(array() as {spans})), "
             f"(a, x) -> named_struct('pos', a.pos + x.skip + x.size, 'out', concat(a.out, {one})), a -> a.out)")
    return steps, inner


def _tested(test: str) -> str:
    return test.replace("{digits}", _DIGITS).replace("{luhn}", _LUHN).replace("{mod97}", _MOD97)


def add_spans(df: DataFrame, kind: str, look: str | None, pattern: str, test: str) -> DataFrame:
    """Column ``kind``: array of (start, stop, score) of the confirmed matches in ``text``."""
    steps, inner = _placed("steps")
    start, up, down = SCORES[kind]
    score = (f"least(1D, greatest(0D, {start}D + if(x.before rlike '(?:{up})', 0.3D, 0D) - if(x.before rlike '(?:{down})', 0.3D, 0D)))")
    seen = f"text rlike {_quoted(pattern)}" + (f" and {look}" if look else "")
    if look:
        seen = f"{look} and text rlike {_quoted(pattern)}"
    step_type = "array<struct<skip:int,size:int,before:string,s:string>>"
    none = "cast(array() as array<string>)"
    df = df.withColumn("found", F.expr(f"if({seen}, regexp_extract_all(text, {_quoted(pattern)}, 0), {none})"))
    df = df.withColumn("gaps", F.expr(f"if(size(found) > 0, split(text, {_quoted(pattern)}, -1), {none})"))
    df = df.withColumn("tails", F.expr(
        f"zip_with(slice(gaps, 1, size(found)), found, (g, m) -> right(concat(right(g, {CONTEXT}), m), {CONTEXT}))"))
    df = df.withColumn("steps", F.expr(_steps())).drop("found", "gaps", "tails")
    df = df.withColumn("blocks", F.expr(
        f"if(size(steps) = 0, cast(array() as array<{step_type}>), transform(sequence(0, int((size(steps) - 1) / {BLOCK})), "
        f"k -> slice(steps, k * {BLOCK} + 1, {BLOCK})))")).drop("steps")
    df = df.withColumn("offsets", F.expr(
        "aggregate(transform(blocks, b -> aggregate(b, 0, (a, x) -> a + x.skip + x.size)), array(0), "
        "(a, x) -> concat(a, array(element_at(a, -1) + x)))"))
    confirmed = f"filter(flatten(transform(blocks, (b, i) -> {inner})), x -> {_tested(test).replace('(s,', '(x.s,').replace('s rlike', 'x.s rlike')})"
    return df.withColumn(kind, F.expr(
        f"transform({confirmed}, x -> named_struct('start', x.start, 'stop', x.stop, 'score', {score}))")).drop("blocks", "offsets")


def find_personal_data(docs: DataFrame, least: float = 0.7) -> DataFrame:
    """One row per document: an array of scored spans per kind, base kinds first."""
    df = texts(docs)
    for kind, (look, pattern, test) in {**BASE_KINDS, **MORE_KINDS}.items():
        df = add_spans(df, kind, look, pattern, test)
    for kind in MORE_KINDS:
        df = df.withColumn(kind, F.filter(kind, lambda x: x["score"] >= least))
    return df.drop("text")


def _joined(kinds) -> str:
    parts = [f"transform({k}, x -> concat('{k}:', x.start, ':', x.stop))" for k in kinds]
    return f"array_join(concat({', '.join(parts)}), ',')"


def scan_personal_data(docs: DataFrame, least: float = 0.7) -> DataFrame:
    """One row per document: counts, digest of the base spans, all spans, and the top score."""
    every = [*BASE_KINDS, *MORE_KINDS]
    df = find_personal_data(docs, least)
    scores = F.concat(*[F.transform(k, lambda x: x["score"]) for k in every])
    return df.select(
        "doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in BASE_KINDS],
        F.sha2(F.expr(_joined(BASE_KINDS)), 256).alias("base_sha256"), F.expr(_joined(every)).alias("spans"),
        F.coalesce(F.array_max(scores), F.lit(0.0)).alias("score"))
