"""Row-wise scans against brute force, on the given documents and on odd texts."""

import hashlib
import os
import random
import re
import textwrap

import pytest

from tests.llm.conftest import by_id
from tidebar.llm import licenses, pii, queries, quality, secrets

SF = "/root/testdata/sf0.01"
FOLDERS = ("odd", "given")


@pytest.fixture(params=FOLDERS)
def folder(request, odd_docs):
    if request.param == "given" and not os.path.isdir(SF):
        pytest.skip("no test data")
    return odd_docs if request.param == "odd" else SF


def rows_of(spark, folder, name):
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text", "lang").collect()
    got = queries.QUERIES[name](spark, folder).collect()
    assert len(got) == len(docs)
    return {d["doc_id"]: (d["text"] or "", d["lang"]) for d in docs if d["doc_id"] is not None}, by_id(got)


def low(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


# -- licenses --------------------------------------------------------------------------------


def brute_licenses(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(text))
    places, base = [], set()
    for phrase, label in licenses.PHRASES:
        p = phrase.split()
        at = [i for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
        places += at
        base |= {label} if at else set()
    found, score = set(base), 0.0
    for label, t in licenses.TEMPLATES:
        stride, t = licenses.stride_of(t), set(licenses.words_of(t.lower()))
        for i in range(0, max(0, len(words) - stride - 1) + 1, stride):
            shared = len(t & set(words[i : i + 2 * stride]))
            if 10 * shared >= 8 * len(t):
                found.add(label)
                score = max(score, shared / len(t))
    return (len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(found)), score)


def test_licenses(spark, folder):
    docs, got = rows_of(spark, folder, "op3_license_scan")
    for i, (text, _) in docs.items():
        r = got[i]
        assert brute_licenses(text) == (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score), text[:200]


def test_notices_over_lines_and_long_templates(spark):
    """Every built-in notice wrapped at 12 to 70 columns and behind a text of any length; a template of 150 words."""
    notices = dict((t, label) for label, t in licenses.TEMPLATES)
    rows = [(f"{'filler ' * k}{textwrap.fill(t, width, break_long_words=False)}\nmore of it", t) for t in notices for k, width in ((0, 12), (3, 30), (9, 70), (41, 40))]
    docs = spark.createDataFrame([(i, text) for i, (text, _) in enumerate(rows)], "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.scan_licenses(docs).collect()}
    for i, (_, t) in enumerate(rows):
        assert notices[t] in got[i].labels.split(",") and got[i].score == 1.0
    long = " ".join(f"w{i}" for i in range(150))
    texts = [f"{'x ' * 333}{textwrap.fill(long, 50)} y", f"a {long.replace('w1', 'v1')}", "x " * 500, long[: len(long) * 85 // 100]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.block_matches(docs, (("long", long), ("short", "x y"))).collect() if r.label == "long"}
    assert set(got) == {0, 3} and got[0].containment == 1.0


# -- personal data ---------------------------------------------------------------------------


def luhn(d):
    return sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0


def brute_pii(text):
    spans = [("email", m) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    spans += [("ip", m) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub(r"[^0-9]", "", m[0])
        spans += [("card", m)] if 16 <= len(d) <= 19 and luhn(d) else []
    spans += [("phone", m) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(re.sub(r"[^0-9]", "", m[0])) <= 15]
    return [f"{k}:{m.start()}:{m.end()}" for k, m in spans]


def mod97(s):
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def ibans(text):
    """Start and end of every IBAN, character by character."""
    out, i = [], 0
    alnum = lambda c: c.isascii() and c.isalnum()
    while i < len(text):
        size, at, got = pii.IBAN_LENGTHS.get(text[i : i + 2], 0), i, ""
        while len(got) < size and at < len(text):
            c = text[at]
            if c == " " and len(got) >= 4 and text[at + 1 : at + 2] not in ("", " "):
                at += 1
                c = text[at]
            if not (alnum(c) and not c.islower()) or 2 <= len(got) < 4 and not c.isdigit():
                break
            got, at = got + c, at + 1
        if size and len(got) == size and not (i and alnum(text[i - 1])) and not (at < len(text) and alnum(text[at])):
            out += [(i, at)] if mod97(got) else []
            i = at
        else:
            i += 1
    return out


def brute_more(text):
    out = [("iban", s, e) for s, e in ibans(text)]
    for m in re.finditer(r"(?<![0-9-])([0-9]{3})-([0-9]{2})-([0-9]{4})(?![0-9-])", text):
        out += [("ssn", *m.span())] if m[1] not in ("000", "666") and m[2] != "00" and m[3] != "0000" else []
    keep = []
    for k, first, end in out:
        before, (start, up, down) = text[max(0, first - 40) : first].lower(), pii.SCORES[k]
        score = start + 0.3 * bool(re.search(up, before)) - 0.3 * bool(re.search(down, before))
        keep += [f"{k}:{first}:{end}"] if score >= 0.7 - 1e-9 else []
    return keep


def test_personal_data(spark, folder):
    docs, got = rows_of(spark, folder, "op6_personal_data")
    for i, (text, _) in docs.items():
        base, r = brute_pii(text), got[i]
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest(), (text[:200], r.spans[:200])
        assert r.spans == ",".join(base + brute_more(text)), text[:200]
        counts = [sum(s.startswith(k) for s in base) for k in ("email", "ip", "card", "phone")]
        assert counts == [r.n_email, r.n_ip, r.n_card, r.n_phone]
        assert 0 <= r.score <= 1


def test_what_follows_an_iban_and_lists_of_numbers(spark):
    texts = ["IBAN DE89370400440532013000 Please pay", "IBAN: DE89 3704 0044 0532 0130 00 BIC: COBADEFFXXX",
             "account DE89 3704 0044 0532 0130 00 12 May", "GB82 WEST 1234 5698 7654 32 DE89370400440532013000",
             "DE89370400440532013000X DE8937040044053201300", "SSN: 123-45-6789, 987-65-4320, 223-45-6789",
             "my ssn:" + " 123-45-6789" * 6, "ssn" + " " * 36 + "!" + "123-45-6789", "ssn" + " " * 37 + "!" + "123-45-6789"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.spans for r in pii.scan_personal_data(df).collect()}
    for i, text in enumerate(texts):
        assert got[i] == ",".join(brute_pii(text) + brute_more(text)), text
    assert [got[i].count("iban") for i in range(5)] == [1, 1, 1, 2, 0]
    assert [got[i].count("ssn") for i in range(5, 9)] == [3, 3, 1, 0]


def test_many_matches_in_one_text(spark):
    text = "é 1.2.3.4 a@b.cd\n" * 700
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    r = pii.scan_personal_data(df).first()
    assert r.spans == ",".join(brute_pii(text)) and r.n_ip == r.n_email == 700


# -- secrets ---------------------------------------------------------------------------------


def brute_secrets(text):
    key = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in k) for k in ("password", "passwd", "secret", "token", "api_?key"))
    spans = [(m.start(), 0, m.end()) for m in re.finditer(rf"""({key})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[2]) >= 6]
    spans += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    spans += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return [f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in sorted(spans)]


def test_secrets(spark, folder):
    docs, got = rows_of(spark, folder, "op7_secret_scan")
    for i, (text, _) in docs.items():
        base, r = brute_secrets(text), got[i]
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest(), text[:200]
        spans = [s for s in r.spans.split(",") if s]
        assert [s for s in spans if not s.startswith("credential")] == base
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(s.startswith(k) for s in base) for k in ("assign", "access", "hex")]


def test_guess_costs():
    cost = lambda v: secrets.guess_cost(v)[0]
    assert cost("password2020") < 5 < 10 < cost("Xk9#vQ2!mZ7p")
    assert cost("aaaaaaaaaaaa") < 4 and cost("qwertyuiop") < 5 and cost("P@ssw0rd") < 3
    for v in ("password2020", "xx20240131qwertyzz", "aaaab!c"):
        total, split = secrets.guess_cost(v)
        assert "".join(v[s:e] for _, s, e in split) == v
    assert [k for k, *_ in secrets.guess_cost("password2020")[1]] == ["word", "date"]
    # the dynamic program's cost is at most that of any single kind of span
    for v in ("monkeydragon", "1999", "zxcvbn"):
        assert cost(v) <= sum(map(secrets._char_cost, v))


def test_credentials_beyond_the_base(spark):
    rows = [(1, "pwd is Xk9#vQ2!mZ7p."), (2, "passphrase: password2020"), (3, "the token of the realm"), (4, "auth: eyJhbGciOiJIUzI1NiJ9")]
    got = {r.doc_id: r for r in secrets.scan_secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].spans == "credential:7:19" and got[1].top_guess_cost > 15
    assert got[2].spans == got[3].spans == "" and got[4].spans.startswith("credential:6:")


def test_words_of_the_corpus_are_no_secrets(spark):
    prose = ["user friendly and well known", "a user friendly chapter", "see chapter four well", "known see four", "password is kqzvxwjhbtmplrdn"]
    asked = ["the secret is user-friendly", "password is well-known", "credentials: see-chapter-four", "passphrase: zqXvbKjwPlmRtYnHg",
             "pwd=kqzvxwjhbtmplrdn", "password is QxZvKjWpLmRtYb"]
    rows = list(enumerate([*asked, *prose * 3, None, ""]))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    ranks = secrets.corpus_ranks(docs)
    seen = {}
    for _, text in rows:
        for w in set(re.findall(r"[^\W\d_]+", secrets.CONTEXT.sub(" ", text or "").lower())):
            seen[w] = seen.get(w, 0) + (3 <= len(w) <= 32)
    order = sorted((w for w, n in seen.items() if n >= 2), key=lambda w: (-seen[w], w))
    assert {w: r for w, r in ranks.items() if w not in secrets.RANKS} == {w: i + 1 for i, w in enumerate(order) if w not in secrets.RANKS}
    assert "kqzvxwjhbtmplrdn" not in ranks and "friendly" in ranks
    # a bound keeps the most frequent words: all of one count or none
    most = len([w for w in order if seen[w] >= 6])
    assert set(secrets.corpus_ranks(docs, most)) - set(secrets.RANKS) == {w for w in order if seen[w] >= 6} - set(secrets.RANKS)
    assert set(secrets.corpus_ranks(docs, 0)) == set(secrets.RANKS)
    got = {r.doc_id: r.spans for r in secrets.scan_secrets(docs).collect()}
    assert [bool(got[i]) for i in range(6)] == [False] * 3 + [True] * 3
    # without the corpus's words they would be
    assert secrets.find_secrets(asked[0])[1]


def test_redaction(spark, odd_docs):
    docs = spark.read.parquet(f"{odd_docs}/documents.parquet")
    out = secrets.redact_secrets(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    for r in out.collect():
        assert r.text is None or (r.n_chars == len(r.text) and not brute_secrets(r.text.replace("[SECRET]", " ")))


# -- quality ---------------------------------------------------------------------------------


def brute_quality(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines, seen, dup = text.split("\n"), set(), 0
    for line in lines:
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    where = {}
    for i in range(len(words) - 2):
        where.setdefault(tuple(words[i : i + 3]), []).append(i)
    covered = {i + k for at in where.values() if len(at) > 1 for i in at for k in range(3)}
    n = len(words)
    return (n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered), n < 50 or 100 * len(covered) > 50 * n)


def test_quality(spark, folder):
    docs, got = rows_of(spark, folder, "op9_quality_rules")
    for i, (text, _) in docs.items():
        r = got[i]
        assert brute_quality(text) == (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed), text[:200]
        assert not (r.base_failed and r.kept)
    if folder == SF:
        kept = sum(r.kept for r in got.values())
        assert kept > 0.8 * sum(not r.base_failed for r in got.values())
        assert not any(r.kept for i, r in got.items() if docs[i][0].count("!!") > 60)


def test_references_are_the_sums_over_all_documents(spark, odd_docs):
    docs = spark.read.parquet(f"{odd_docs}/documents.parquet")
    refs = quality.language_references(docs)
    rows = [(r.text or "").encode() for r in docs.collect()]
    assert refs[None][0].tolist() == sum(map(quality.char_histogram, rows)).tolist()
    assert refs[None][1].tolist() == sum(quality.word_histogram(r.split()) for r in rows).tolist()
    assert set(refs) == {"en", None}
    assert sum(refs[None][0]) == sum(len(r.decode()) for r in rows)


def test_text_without_common_words_fails(spark):
    rng = random.Random(4)
    stem = lambda: "".join(rng.choice("abcdefghijklmnoprstu") for _ in range(rng.randint(5, 9)))
    prose = lambda lang, n: " ".join(rng.choice(quality.COMMON_WORDS[lang].split()) if rng.random() < 0.28 else stem() for _ in range(n))
    good = [(lang, prose(lang, rng.randint(50, 400))) for lang in ("en", "fr", "de", "es") for _ in range(40)]
    bad = [(lang, " ".join(stem() for _ in range(200))) for lang in ("en", "und", "und", "und", None)]
    other = [("zh", " ".join("".join(chr(rng.randint(0x4E00, 0x9000)) for _ in range(3)) for _ in range(200))) for _ in range(3)]
    rows = [(i, t, lang) for i, (lang, t) in enumerate([*good, *bad, *other])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    kept = {r.doc_id for r in quality.quality_rules(docs).collect() if r.kept}
    assert not kept & {i for i in range(len(good), len(good) + len(bad))}
    assert kept >= set(range(len(good))) and kept >= set(range(len(good) + len(bad), len(rows)))
    assert {r.doc_id for r in quality.keep_good(docs).collect()} == kept


def test_divergence():
    import numpy as np

    p = np.array([3.0, 1, 0])
    assert quality.divergence(p, p) == 0 and quality.divergence(p, np.array([0, 0, 5.0])) == 1
    assert 0 < quality.divergence(p, np.array([2.0, 2, 0])) < 1


# -- all -------------------------------------------------------------------------------------


@pytest.mark.parametrize("name", ["op3_license_scan", "op6_personal_data", "op7_secret_scan", "op9_quality_rules"])
def test_empty_table(spark, odd_docs, name):
    assert queries.QUERIES[name](spark, f"{odd_docs}/empty").collect() == []
