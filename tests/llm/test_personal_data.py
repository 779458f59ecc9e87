import hashlib
import re
import time

from pyspark.sql import functions as F

from orgatlas.llm import personal_data

KIND = ("email", "ip", "card", "phone")
EMAIL, IP = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD, PHONE = re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(s):
    return sum((lambda v: v - 9 if v > 9 else v)(int(c) * (1 + i % 2)) for i, c in enumerate(reversed(s))) % 10 == 0


def brute(x):
    digits = lambda s: re.sub("[^0-9]", "", s)
    out = [(m.start(), 0, m.end()) for m in EMAIL.finditer(x)] + [(m.start(), 1, m.end()) for m in IP.finditer(x) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [(m.start(), 2, m.end()) for m in CARD.finditer(x) if 12 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    return sorted(out + [(m.start(), 3, m.end()) for m in PHONE.finditer(x) if 9 <= len(digits(m[0])) <= 15])


TEXTS = [
    "mail a.b+c@d-e.example.org, x@y@z.example and 1.2.3.4.5.6.7.8 or 300.1.1.1 and 0010.020.0003.255", "4111 1111 1111 1111 and 4111-1111-1111-1112, 12345678901234567890123 4 5", "call +49 (30) 123-456 78, +1 2, +44 20 7946 0958.",
    "😀😀 4111111111111111 ü a@b.co.", "", "5500 0000 0000 0004+1 (555) 123 4567a@b.c d@e.f%g@h.i", "no data here", "1 2 3 4 5 6 7 8 9 0 1 2 3", "a@b a@.c a@b. a@b..c a@b.c.d@e.f a@b.c@d.e", "1.2.3.4.", "12.34.56.78.90 1.2.3.4+49 301234567",
]

HARD = ["a@b" + ".cc" * 50_000, "x" * 400_000 + " x@y.zz", "x" * 400_000 + "@", "1" * 300_000 + ".1.1.1", "9 " * 200_000, "+1" + " ." * 200_000, "1." * 200_000, " ".join(f"10.{i // 250}.{i % 250}.7" for i in range(50_000)), "a@" * 100_000, "😀 1.2.3.4 é " * 3_000]


def check(found, texts):
    assert len(found) == len(texts)
    for r in found:
        spans = brute(texts[r.doc_id])
        text = ",".join(f"{KIND[k]}:{a}:{b}" for a, k, b in spans)
        assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest(), (texts[r.doc_id][:80], r.spans[:80], text[:80])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == n for _, k, _ in spans) for n in range(4)]


def test_base_spans_equal_brute_force(make_docs, odd_docs, no_docs):
    check(personal_data.find_personal_data(make_docs(list(enumerate(TEXTS)))).collect(), TEXTS)
    assert personal_data.find_personal_data(odd_docs).count() == 8
    assert personal_data.find_personal_data(no_docs).count() == 0 and personal_data.sanitise(no_docs).count() == 0
    assert personal_data.sanitise(odd_docs).count() == 8 and personal_data.sanitise(odd_docs).columns == odd_docs.columns


def test_long_runs_and_many_matches(make_docs):
    start = time.time()
    docs = make_docs(list(enumerate(HARD)))
    # what a backtracking e-mail pattern needs for these is quadratic in Python as well: the expected spans are stated
    known = {0: [(0, 0, 150_003)], 1: [(400_001, 0, 400_007)], 2: [], 3: [], 5: [], 6: [(8 * i, 1, 8 * i + 7) for i in range(50_000)], 8: []}
    for r in personal_data.find_personal_data(docs).collect():
        spans = known.get(r.doc_id, None) if r.doc_id in known else brute(HARD[r.doc_id])
        assert r.spans.split(",") == ([f"{KIND[k]}:{a}:{b}" for a, k, b in spans] or [""]), r.doc_id
    clean = {r.doc_id: r.text for r in personal_data.sanitise(docs).collect()}
    assert clean[0] == "<email>" and clean[7] == " ".join(["<ip>"] * 50_000) and clean[9] == "😀 <ip> é " * 3_000
    assert time.time() - start < 150


def test_running_totals(spark):
    df = spark.createDataFrame([(list(range(1, n + 1)),) for n in (0, 1, 127, 128, 129, 1000)], "v array<int>")
    for r in df.select("v", personal_data.running(F.col("v"), lambda a, x: a + x).alias("s")).collect():
        assert r.s == [sum(r.v[: i + 1]) for i in range(len(r.v))]


def disclosures(rows):
    """(entity, term) -> disclosure by counting, over different texts."""
    import math

    texts = {t for _, t in rows}
    held = {t: [(KIND[k], t[a:b]) for a, k, b in brute(t)] for t in texts}
    words = {t: {w.lower() for w in re.findall(r"[^\W\d_]{4,}", t)} for t in texts}
    plain = {t: {w.lower() for w in re.findall(r"[^\W\d_]{4,}", "".join(" " if any(a <= i < b for a, _, b in brute(t)) else c for i, c in enumerate(t)))} for t in texts if held[t]}
    out = {}
    for e in {e for es in held.values() for e in es}:
        with_e = [t for t in texts if e in held[t]]
        for w in {w for t in with_e for w in plain[t]}:
            both, alone, share = sum(w in plain[t] for t in with_e), sum(w in words[t] for t in texts), len(with_e) / len(texts)
            if both >= 3 and len(with_e) < len(texts):
                out[e, w] = math.log((both + 2 * share) / (max(alone, both) + 2) / share) / -math.log(share)
    return held, plain, out


def test_terms_that_reveal_an_entity(make_docs):
    fill = ["the", "quick", "brown", "foxes", "jump", "over", "lazy", "dogs", "under", "green", "trees"]
    rows = [(i, f"{fill[i % 11]} note {fill[i % 7]}: director Quillfeather wrote jane@corp.example about {fill[i % 5]} matters far from here, said Quillfeather") for i in range(8)]
    rows += [(100 + i, f"plain text {fill[i % 11]} about {fill[i % 5]} {i} matters and a director note") for i in range(200)]
    rows += [(400 + i, rows[3][1]) for i in range(300)] + [(None, rows[3][1])]  # copies change nothing
    rows += [(800 + i, f"{fill[i % 11]} seldom {i} umbral word 10.1.2.3" if i < 30 else f"{fill[i % 7]} item {i}") for i in range(60)]
    held, plain, rated = disclosures(rows)
    docs = make_docs(rows)
    found = {(r.doc_id, r.spans): r for r in personal_data.find_personal_data(docs).collect()}
    text = dict(rows)
    for r in found.values():
        own = text[r.doc_id]
        got = {own[int(a) : int(b)].lower() for k, a, b in (s.split(":") for s in r.spans.split(",") if s) if k == "term"}
        want = {w for e in held[own] for w in plain[own] if rated.get((e, w), 0) >= personal_data.DISCLOSING}
        assert got == want, (own, got, want)
    assert {"quillfeather"} <= {w for (e, w), d in rated.items() if d >= personal_data.DISCLOSING} and rated[("email", "jane@corp.example"), "director"] < personal_data.DISCLOSING
    clean = [(r.doc_id, r.text) for r in personal_data.sanitise(docs).collect()]
    assert len(clean) == len(rows) and all("Quillfeather" not in t and "jane@corp" not in t for _, t in clean) and dict(clean)[100] == text[100]


def test_generalise_and_remove(make_docs, monkeypatch):
    rows = [(i, f"number {i} Quillfeather wrote from 10.9.8.7 again") for i in range(9)] + [(50 + i, f"number {i} other words again") for i in range(400)]
    docs = make_docs(rows)
    assert {r.text for r in personal_data.sanitise(docs).collect() if r.doc_id < 9} == {f"number {i} <term> <term> from <ip> again".replace("from", "<term>") for i in range(9)}
    monkeypatch.setattr(personal_data, "REVEALING", 0.85)
    assert {r.text for r in personal_data.sanitise(docs).collect() if r.doc_id < 9} == {f"number {i}    <ip> again" for i in range(9)}
    r = personal_data.find_personal_data(docs).where("doc_id = 0").first()
    assert (r.n_generalised, r.n_removed) == (0, 3)


def test_terms_in_texts_without_entities(make_docs):
    """A term reveals its entity in any text, also beside other entities and in copies."""
    rows = [(i, f"number {i} Quillfeather wrote from 10.9.8.7 again") for i in range(9)] + [(50 + i, f"number {i} other words again") for i in range(400)]
    odd = [(900, "here QUILLFEATHER stands alone"), (901, "here QUILLFEATHER stands alone"), (None, "here QUILLFEATHER stands alone"), (902, "Quillfeather mails quillfeather@b.example")]
    docs = make_docs(rows + odd)
    clean = {r.doc_id: r.text for r in personal_data.sanitise(docs).collect()}
    assert [clean[i] for i in (900, 901, None, 902)] == ["here <term> stands alone"] * 3 + ["<term> mails <email>"]
    assert clean[50] == rows[9][1] and len(clean) == len(rows + odd)
    found = {r.doc_id: r for r in personal_data.find_personal_data(docs).collect()}
    assert [found[i].spans for i in (900, 901, None, 902)] == ["term:5:17"] * 3 + ["term:0:12,email:19:41"]
    assert all(found[i].n_generalised == 1 and found[i].clean_sha256 == hashlib.sha256(clean[i].encode()).hexdigest() for i in (900, 901, None, 902))
    assert (found[50].spans, found[50].n_generalised, found[50].clean_sha256) == ("", 0, None)


def test_no_python_in_the_plan(make_docs):
    docs = make_docs([(1, "a@b.c")])
    for df in (personal_data.scanned(docs), personal_data.find_personal_data(docs), personal_data.sanitise(docs)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan
