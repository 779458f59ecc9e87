"""Fixed expectations of single operators, on small inline rows."""

import json

import pytest
from pyspark.sql import functions as F

from orgatlas.functions import mojibake
from orgatlas.functions import text as T
from orgatlas.functions import urls as U
from orgatlas.functions.similarity import name_similarity
from orgatlas.operators import enrich as E
from orgatlas.operators import extract as X
from orgatlas.operators import frontier as N
from orgatlas.operators import gapfill as G
from orgatlas.operators import profile as R
from orgatlas.operators import registers as M
from orgatlas.operators import search as S
from orgatlas.sources import places as P
from orgatlas.sources.html import parse_pages


def one(spark, column, *values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in rows.orderBy("i").select(column(F.col("v"))).collect()]


def test_urls(spark):
    assert one(spark, U.normalize_url, "Example.com/a/?utm_source=x&B=1#f", "HTTP://A.b:80", "", "https://a.b/x;p=1/?q") == ["https://example.com/a?B=1", "http://a.b:80/", "", "https://a.b/x;p=1?q="]
    assert one(spark, U.site_domain, "https://www.Nishat.net/careers", "facebook.com/x", "http://www2.acme.co.uk.", "localhost", None) == ["nishat.net", None, "acme.co.uk", None, None]
    assert one(spark, U.alternate_urls, "http://www.a.com/x", "https://a.com") == [["https://www.a.com", "https://a.com", "http://a.com"], ["https://www.a.com"]]
    base = lambda href: U.canonical_link(F.lit("https://h.example/dir/page.html?x=1"), href)
    assert one(spark, base, "other", "/root/", "//cdn.example/z", "?q=2", "tel:1", "pic.PNG", "") == ["https://h.example/dir/other", "https://h.example/root", "https://cdn.example/z", "https://h.example/dir/page.html?q=2", None, None, None]


def test_names(spark):
    assert one(spark, T.stem, "medicine", "textiles", "mills", "class", "it") == ["medic", "texti", "mill", "cla", "it"]
    assert one(spark, T.sibling_key, "Acme (Pvt) Ltd.", "The Acme Group", None) == ["acme", "theacme", ""]
    assert one(spark, T.map_key, "The Acme Company Ltd.") == ["acme"]
    assert one(spark, T.display_name, "SMITH, JANE ANN", "de la Cruz", " o'neil ") == ["Jane Ann Smith", "De La Cruz", "O'neil"]
    assert one(spark, T.employee_range, "7", "51", "10001", None) == ["1-10", "51-200", "10000+", None]


def test_name_similarity(spark):
    rows = spark.createDataFrame([("Acme Textiles (Pvt) Ltd", "ACME TEXTILES LIMITED"), ("Acme Textile", "Acme Textiles"), ("Ltd", "Acme"), ("Alpha", "Zorro")], "a string, b string")
    a, b, c, d = [r[0] for r in rows.select(name_similarity(F.col("a"), F.col("b"))).collect()]
    assert (a, c) == (1.0, 0.0) and 0.9 < b < 1 and d < 0.5


def test_mojibake(spark):
    rows = spark.createDataFrame([(1, "â€œquotedâ€\x9d text"), (2, "plain — text"), (3, None), (4, "CafÃ©\nÃ bad € Ã")], "i int, t string")
    got = {r.i: r.t for r in mojibake.fix_mojibake(rows, "t").collect()}
    assert got[1] == "“quoted” text" and got[2] == "plain — text" and got[3] is None and got[4].startswith("Café\n")


LINES = [
    ("Jane Doe – Chief Executive Officer", [("Jane Doe", "Chief Executive Officer")]),
    ("Bilal\nMahmood\nManaging Director", [("Bilal Mahmood", "Managing Director")]),
    ("Amna Khan\n• CEO.", [("Amna Khan", "CEO")]),
    ("Founder\nOmar Sheikh", [("Omar Sheikh", "Founder")]),
    ("Message from the CEO\nOur Vision", []),
    ("Company Profile\nChairman", []),
    ("Birthday Celebration\nCEO", []),
]


def test_people_layouts(spark):
    rows = [(i, pos, line) for i, (text, _) in enumerate(LINES) for pos, line in enumerate(text.split("\n"))]
    found = X.people(spark.createDataFrame(rows, "page_id long, pos int, line string")).orderBy("page_id", "pos").collect()
    for i, (_, want) in enumerate(LINES):
        assert [(r.name, r.title) for r in found if r.page_id == i] == want


def test_phone_rules(spark):
    got = one(spark, X.phone_matches, "Tel (042) 3749 1234 or +92 21 3456 7890", "in 1998-2004 and 2001-05", "at 192.168.100.200", "12-34-56", "042-111-222", "+923001234567")
    assert got == [["(042) 3749 1234", "+92 21 3456 7890"], [], ["192.168.100.200"], [], [], ["+923001234567"]]


PAGE = """<html><head><title>Acme | Home</title><meta name="description" content="We make  things"><meta property="og:site_name" content="Acme Site">
<script type="application/ld+json">{"@graph":[{"@type":"Organization","name":"Acme Ltd","founder":{"name":"Ann Lee"},"address":{"streetAddress":"1 Road","addressLocality":"Lahore"}},{"@type":"WebPage"}]}</script>
<script type="application/ld+json">{bad</script></head><body><h1>Who we are</h1><h2>Who We Are</h2><a href="mailto:Info@Acme.example?x=1">mail</a> <a href="tel:+92 42 111">call</a>
<a href="/services/web"><h3>Web work</h3><p>More text</p></a><a href="/team">Read more</a><a href="https://www.linkedin.com/company/acme">in</a><div class="Client-logos"><img alt="Globex logo"><img alt="Initech"></div>
<address>Suite 4<br>12 Mall Road, Lahore<br>+92 42 1234 5678<br>info@acme.example</address><p>Ann Lee</p><p>CEO</p><p>ISO 9001:2015 and iso 9001:2015, SOC 2 Type II</p></body></html>"""


@pytest.fixture(scope="module")
def parsed(spark):
    return parse_pages(spark.createDataFrame([(1, "https://acme.example/about", PAGE)], "page_id long, url string, html string")).persist()


def test_page_parts(spark, parsed):
    hrefs = F.transform("links", lambda a: a["href"])
    row = parsed.first()
    assert (row.title, row.description, row.site_name, row.n_scripts) == ("Acme | Home", "We make things", "Acme Site", 2)
    assert [r.value for r in X.headings(parsed).collect()] == ["Who we are", "Web work"]
    assert {json.loads(r[0]).get("name") for r in X.jsonld_objects(parsed).select(F.to_json("object")).collect()} == {"Acme Ltd", None}
    assert [r.value for r in X.emails(parsed, F.array_join("lines", " "), hrefs, "page_id").collect()] == ["info@acme.example"]
    assert [r.value for r in X.phones(parsed, F.col("lines"), hrefs, "page_id").collect()][:2] == ["+92 42 111", "+92 42 1234 5678"]
    assert [(r.link, r.label) for r in X.internal_links(parsed).collect()] == [("https://acme.example/services/web", "Web work")]
    assert [r.value for r in X.client_logos(parsed).collect()] == ["Globex", "Initech"]
    assert [r.value for r in X.addresses(parsed.withColumn("category", F.lit("about"))).collect()] == ["Suite 4, 12 Mall Road, Lahore"]
    assert [(r.name, r.title) for r in X.people(X.lines_of(parsed)).collect()] == [("Ann Lee", "CEO")]
    assert [r.value for r in X.certifications(parsed, F.array_join("lines", " "), "page_id").collect()] == ["ISO 9001:2015", "SOC 2 Type II"]


def test_address_lines(spark):
    lines = ["Head office:", "Floor 3,", "Tower B, Main Street 12,", "Karachi", "no, numbers, here street", ""]
    page = spark.createDataFrame([(1, "u", lines, [], "contact")], "page_id long, url string, lines array<string>, addresses array<array<string>>, category string")
    assert [r.value for r in X.addresses(page).collect()] == ["Floor 3, Tower B, Main Street 12, Karachi"]


def test_profile_end_to_end(spark):
    pages = spark.createDataFrame([(1, "https://acme.example/about", PAGE), (2, "https://acme.example/x", "<title>Other - x</title><h1>Hello</h1>")], "page_id long, url string, html string")
    got = R.crawl_profile(pages, U.domain(F.col("url")), F.when(F.col("page_id") == 1, "about").otherwise("other")).first()
    assert got.company_name == ["Acme Ltd"] and got.website == ["https://acme.example/about"] and got.founder_ceo == ["Ann Lee"] and got.locations == ["1 Road, Lahore"]
    assert got.description == ["We make things"] and got.business_email == ["info@acme.example"] and got.clients == ["Globex", "Initech"] and got.confidence["company_name"] == 0.99


def test_relevance_tiers(spark):
    rows = [(1, "textile_manufacturer", ["manufacturing", "textile_manufacturer"]), (2, "weaver", ["a", "textile_goods", "weaver"]), (3, "spinning_mill", ["a", "spinning_mill"]), (4, "shop", ["a", "garment_x", "shop"]), (5, "cafe", ["food", "cafe"])]
    hits = spark.createDataFrame([(i, "n", c, h, []) for i, c, h in rows], "id long, name string, category_primary string, hierarchy array<string>, alternates array<string>")
    got = {r.id: (r.tier, r.match) for r in S.relevance(hits, S.parse_industry("Textiles industry")).collect()}
    assert got == {1: (3, "category"), 2: (2, "parent category"), 3: (2, "related category"), 4: (1, "related parent category"), 5: (0, "name only")}
    assert S.parse_industry("Textiles") == S.parse_industry("textile companies") and S.parse_industry("& the") == []


def places(spark, n=400):
    rows = [(i, f"{('Acme', 'Bolt', 'Coil')[i % 3]} Steel {i % 40} Ltd", "steel_mill", ["industry", "steel_mill"], [], f"https://www.s{i % 25}.example/x" if i % 3 else None, None, f"a@{i}.example" if i % 7 == 0 else None, "PK", f"City{i % 4}", (i % 10) / 10, None) for i in range(n)]
    return spark.createDataFrame(rows, "id long, name string, category_primary string, hierarchy array<string>, alternates array<string>, website string, phone string, email string, country string, city string, confidence double, operating_status string")


def test_search_does_not_depend_on_partitions_or_spelling(spark):
    table = places(spark)
    run = lambda rows, words: [tuple(r) for r in S.company_search(rows, words, "pk", limit=30).select("id", "site", "locations", F.round("score", 6)).collect()]
    want = run(table.coalesce(1), "steel")
    assert want == run(table.repartition(7, "city"), "Steels") == run(table.orderBy(F.desc("id")), "STEEL company") and len(want) == 30
    assert run(table, "unknownword") == [] and len({r[1] for r in want if r[1]}) == len([r for r in want if r[1]])


def test_siblings_and_closed_places(spark):
    rows = [(2, "Acme Ltd", None), (1, "ACME (Pvt) Limited", "https://a.example"), (3, "abc", None)]
    hits = spark.createDataFrame([(i, n, w, None, None) for i, n, w in rows], "id long, name string, website string, phone string, email string")
    got = {r.id: (r.website, r.filled_from) for r in S.fill_from_siblings(hits).collect()}
    assert got == {2: ("https://a.example", {"website": "sibling listing"}), 1: ("https://a.example", {}), 3: (None, {})}
    states = spark.createDataFrame([(1, "n", "pk", "temporarily_closed"), (2, "n", "PK", "closed"), (3, "n", "PK", None), (4, None, "PK", "open")], "id long, name string, country string, operating_status string")
    assert sorted(r.id for r in S.valid_places(states, "pk").collect()) == [1, 3]


def test_extract_equals_direct_scan(spark, tmp_path):
    nested = places(spark).select(F.col("id").cast("string").alias("id"), F.struct(F.col("name").alias("primary")).alias("names"), F.struct(F.col("category_primary").alias("primary"), "hierarchy", "alternates").alias("taxonomy"), F.array("website").alias("websites"), F.array(F.struct("city", "country")).alias("x"), "confidence")
    nested = nested.withColumn("addresses", F.transform("x", lambda a: F.struct(F.lit(None).cast("string").alias("freeform"), a["city"].alias("locality"), F.lit(None).cast("string").alias("region"), F.lit(None).cast("string").alias("postcode"), a["country"].alias("country")))).drop("x")
    nested.write.parquet(str(tmp_path / "places"))
    read = P.read_places(spark, str(tmp_path / "places"))
    P.write_country_extract(read, str(tmp_path / "extract"), "2026-01-01")
    part = P.read_country_extract(spark, str(tmp_path / "extract"), "pk")
    assert sorted(r.id for r in part.collect()) == sorted(r.id for r in P.flatten(read).where("upper(country) = 'PK'").collect())


def test_merge_best_and_missing(spark):
    row = [("https://a.example", "listing@x", None, ["https://facebook.com/a"], {"email": "sibling listing"}, [], [], [], {})]
    schema = "website string, email string, phone string, socials array<string>, filled_from map<string,string>, emails array<struct<email:string,on_company_domain:boolean>>, phones array<struct<raw:string,e164:string,valid:boolean>>, people array<struct<name:string>>, social map<string,string>"
    got = G.merge_best(spark.createDataFrame(row, schema)).first()
    assert got.best == {"website": "https://a.example", "email": "listing@x", "social_facebook": "https://facebook.com/a"} and got.best_source["email"] == "sibling listing" and got.missing == ["phone", "contact_person"]


def test_register_matching(spark):
    firms = spark.createDataFrame([(1, "Acme Textiles", "gb", "acme.example"), (2, "Nothing Alike", "gb", "none.example"), (3, "Zenith Works", "pk", "zenith.example")], "company_id long, name string, country string, domain string")
    register = spark.createDataFrame([(10, "ACME TEXTILES LIMITED", "gb", "Dissolved", True), (11, "ACME TEXTILES LTD", "gb", "Active", False), (12, "ACME TEXTILE TRADERS", "gb", "Active", False), (13, "ZENITH WORKS", "us_de", "Active", False), (14, "SOMETHING ELSE", "gb", "Active", False)], "record_id long, name string, jurisdiction_code string, current_status string, inactive boolean")
    got = {r.company_id: (r.record_id, r.match_confidence) for r in M.match_register(firms, register).collect()}
    assert got == {1: (11, 1.0), 3: (13, 1.0)}


def test_robots_and_classes(spark):
    urls = spark.createDataFrame([("https://h.example/en/4/x",), ("https://h.example/en/5",), ("https://other.example/en",)], "url string")
    rules = spark.createDataFrame([("h.example", "/en", False), ("h.example", "/en/4", True)], "host string, path_prefix string, allow boolean")
    assert {r.url: r.allowed for r in N.robots_gate(urls, rules).collect()} == {"https://h.example/en/4/x": True, "https://h.example/en/5": False, "https://other.example/en": True}


def test_mail_setup(spark):
    rows = [("a.example", "MX", "10 aspmx.l.google.com."), ("a.example", "TXT", '"v=spf1 include:_spf.google.com include:mailgun.org ~all"'), ("a.example", "TXT", "google-site-verification=1"), ("a.example", "DMARC", "v=DMARC1; p=reject"), ("b.example", "TXT", "x")]
    got = {r.domain: r for r in E.mail_setup(spark.createDataFrame(rows, "domain string, rtype string, data string")).collect()}
    a = got["a.example"]
    assert (a.email_provider, a.email_senders, a.dmarc_policy, a.txt_verifications, a.accepts_email) == ("Google Workspace", ["Google Workspace", "Mailgun"], "reject", ["google"], True)
    assert not got["b.example"].accepts_email and got["b.example"].email_provider is None


def test_alike_map_names_lose_no_pair(spark):
    """Against all pairs: keys with edits near both ends, inserted and missing letters, short and long keys."""
    import difflib
    import random

    from orgatlas.operators import gapfill

    rng = random.Random(3)
    names = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(6, 40))) for _ in range(60)] + ["globaltextileindustries", "acme"]
    edited = []
    for name in names:
        for _ in range(4):
            letters = list(name)
            for _ in range(rng.randrange(0, 5)):
                i = rng.randrange(len(letters))
                rng.choice([lambda: letters.insert(i, "z"), lambda: letters.pop(i) if len(letters) > 5 else None, lambda: letters.__setitem__(i, "y")])()
            edited.append("".join(letters))
    edited += ["glabaltextileindustreis"]
    companies = spark.createDataFrame([(i, n, "gb") for i, n in enumerate(names)], "company_id long, name string, country string")
    places = spark.createDataFrame([(i, n, "GB", {"website": f"w{i}"}) for i, n in enumerate(edited)], "ord long, name string, country string, tags map<string,string>")
    found = {(r.company_id, r.ord) for r in gapfill.osm_matches(companies, places).collect()}
    assert found == {(i, j) for i, a in enumerate(names) for j, b in enumerate(edited) if difflib.SequenceMatcher(None, a, b).ratio() >= 0.9}


def test_alike_names_of_common_words_meet_few(spark):
    """Names of two common words and a number: the candidates are few, and the pairs those of all pairs."""
    import difflib
    import random

    from orgatlas.operators import gapfill

    rng = random.Random(8)
    name = lambda: f"{rng.choice(['global', 'national', 'united'])}{rng.choice(['trading', 'textile', 'machinery'])}{rng.choice(['', 'exporthouse'])}{rng.randrange(10**4)}"
    names, others = sorted({name() for _ in range(300)}), sorted({name() for _ in range(300)})
    companies = spark.createDataFrame([(i, n, "gb") for i, n in enumerate(names)], "company_id long, name string, country string")
    places = spark.createDataFrame([(i, n, "GB", {"website": f"w{i}"}) for i, n in enumerate(others)], "ord long, name string, country string, tags map<string,string>")
    want = {(i, j) for i, a in enumerate(names) for j, b in enumerate(others) if difflib.SequenceMatcher(None, a, b).ratio() >= 0.9}
    assert {(r.company_id, r.ord) for r in gapfill.osm_matches(companies, places).collect()} == want
    met = gapfill.alike_candidates(*gapfill.keys_of(companies, places)).count()
    assert met <= 1.5 * len(want) + len(names)


def test_register_candidates_keep_the_best_match(spark):
    """With every token frequent: all names that are alike to six tenths and share two words meet, in any word order; recall against all pairs."""
    import difflib
    import random

    from orgatlas.operators import registers

    rng = random.Random(4)
    words = [f"word{c}" for c in "abcdefghijkl"]
    record = [(str(i), " ".join(rng.sample(words, rng.randrange(2, 5))), "gb", "Active", False) for i in range(400)]
    record += [("900", "wordb worda", "gb", "Active", False), ("901", "solo", "gb", "Active", False), ("902", "solo", "us_de", "Active", False)]
    company = [(i, record[i * 7][1], "gb") for i in range(50)] + [(100, "worda wordb", "gb"), (101, "solo", "gb")]
    companies, registry = spark.createDataFrame(company, "company_id long, name string, country string"), spark.createDataFrame(record, "record_id string, name string, jurisdiction_code string, current_status string, inactive boolean")
    found = {(r.company_id, r.record_id) for r in registers.candidates(companies, registry, max_token_freq=1).collect()}
    assert (100, "900") in found and {(101, "901"), (101, "902")} <= found
    best = {i: max(difflib.SequenceMatcher(None, n, r[1]).ratio() for r in record) for i, n, _ in company}
    names = {r[0]: r[1] for r in record}
    hit = [any(difflib.SequenceMatcher(None, n, names[r]).ratio() == best[i] for c, r in found if c == i) for i, n, _ in company]
    assert sum(hit) >= 0.9 * len(hit)


def test_phone_numbers_by_numbering_plan(spark):
    """Well-known numbers of ten regions, written as people write them."""
    good = [("US", "(212) 736-5000", "+12127365000"), ("GB", "020 7930 4832", "+442079304832"), ("PK", "0300 1234567", "+923001234567"), ("IN", "098200 12345", "+919820012345"), ("DE", "030 227 32152", "+493022732152"),
            ("FR", "01 40 20 50 50", "+33140205050"), ("AE", "04 366 8888", "+97143668888"), ("SG", "6336 9433", "+6563369433"), ("AU", "(02) 9250 7111", "+61292507111"), ("ES", "913 30 28 00", "+34913302800")]
    bad = [("US", "736-5000"), ("US", "112 736 5000"), ("GB", "020 7930 48"), ("PK", "0300 12345"), ("FR", "00 40 20 50"), ("SG", "1336 9433"), ("AE", "04 366 88888"), ("ZZ", "12345678")]
    rows = [(i, raw, 0) for i, (_, raw, _) in enumerate(good)] + [(100 + i, raw, 0) for i, (_, raw) in enumerate(bad)] + [(300, "+33 6 12 34 56 78", 0), (300, "0033612345678", 1), (300, "+999 12345", 2), (300, "020 7930 4832", 3)]
    where = [(i, [r]) for i, (r, _, _) in enumerate(good)] + [(100 + i, [r]) for i, (r, _) in enumerate(bad)] + [(300, ["PK", "GB"])]
    phones, regions = spark.createDataFrame(rows, "company_id long, raw string, ord int"), spark.createDataFrame(where, "company_id long, regions array<string>")
    got = {}
    for r in E.phone_numbers(phones, regions, E.number_plans(spark)).orderBy("place").collect():
        got.setdefault(r.company_id, []).append((r.e164, r.valid, r.region, r.kind))
    assert [got[i][0][:3] for i in range(len(good))] == [(e164, True, region) for region, _, e164 in good]
    assert all(got[100 + i] == [(None, False, None, None)] for i in range(len(bad)))
    assert got[300] == [("+33612345678", True, "FR", "mobile"), ("+442079304832", True, "GB", "fixed"), (None, False, None, None)]


def test_every_signature_is_found_and_needs_its_texts(spark):
    from orgatlas.functions import technology
    from orgatlas.plans.page_queries import EACH

    for _, name, _, pattern, text in EACH:
        assert __import__("re").search(pattern, text, 2) and any(technology.required(b) in text.lower() for b in technology.branches(pattern.lower())), name
    assert technology.required(r"react-dom(\.production)?(\.min)?\.js") == "react-dom" and technology.required(r"aw-\d{6,}") == "aw-" and technology.branches(r"a(b|c)|[|]d|e\|f") == ["a(b|c)", "[|]d", r"e\|f"]
    pages = spark.createDataFrame([(k, f"<p>{text}</p>") for k, *_, text in EACH], "page_id long, html string")
    found = {(r.page_id, r.name) for r in technology.detect_tech(pages).collect()}
    assert {(k, name) for k, name, *_ in EACH} <= found


def test_search_hits_are_those_of_each_search(spark):
    """Against one filter per search, with related words, long alternatives and terms inside words."""
    names = ["Soft Works", "Microsoft Hub", "Machinery & Sons", "the machine-shop", "IT Company", "Information_Technology Ltd", "Knitwear House", "Texture", "Éclair textil", "a x machi", None, ""]
    rows = [(i, n, ("software_house", "knitwear_shop", None, "builder")[i % 4], (["services", "it_company"], [], ["a", "real_estate_developer"])[i % 3], ("open", "closed", None)[i % 3 if i < 9 else 0], ("PK", "pk", "US")[i % 3]) for i, n in enumerate(names * 3)]
    table = spark.createDataFrame(rows, "id long, name string, category_primary string, hierarchy array<string>, operating_status string, country string")
    asked = [("a", "Software", "pk"), ("b", "software", "PK"), ("c", "textile machinery", "us"), ("d", "construction", "us"), ("e", "it", "pk"), ("f", "the companies", "pk"), ("g", "machinery machinery", "us"), ("h", None, "pk"), ("i", "garments", None)]
    got = {(r.query_id, r.id) for r in S.search_hits(table, spark.createDataFrame(asked, "query_id string, industry string, country string")).collect()}
    want = {(q, r.id) for q, text, country in asked if country and S.parse_industry(text) for r in S.term_filter(S.valid_places(table, country), S.parse_industry(text)).collect()}
    assert got == want and {q for q, _ in want} >= {"a", "b", "d", "e"}


def test_boxes_hold_what_lies_in_them(spark):
    import random

    rng = random.Random(5)
    points = [(i, rng.uniform(-180, 180), rng.uniform(-90, 90)) for i in range(400)] + [(900, None, 1.0), (901, -180.0, -90.0), (902, 0.0, 0.0)]
    boxes = [(i, x := rng.uniform(-180, 150), y := rng.uniform(-90, 60), x + 10 ** rng.uniform(-3, 2.4), y + 10 ** rng.uniform(-3, 2)) for i in range(60)] + [(70, -180.0, -90.0, 180.0, 90.0), (71, 0.0, 0.0, 0.0, 0.0), (72, 5.0, 5.0, 4.0, 6.0)]
    found = P.within_boxes(spark.createDataFrame(points, "id long, lon double, lat double"), spark.createDataFrame(boxes, "box_id long, x0 double, y0 double, x1 double, y1 double"))
    want = {(i, b) for i, x, y in points if x is not None for b, x0, y0, x1, y1 in boxes if x0 <= x <= x1 and y0 <= y <= y1}
    rows = [(r.id, r.box_id) for r in found.collect()]
    assert set(rows) == want and len(rows) == len(want)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def scanned(frame):
    """(files, rows) that the scan of a frame read."""
    frame.collect()
    leaves = frame._jdf.queryExecution().executedPlan().collectLeaves()
    found = [leaves.apply(i).metrics() for i in range(leaves.size())]
    return tuple(sum(m.apply(name).value() for m in found) for name in ("numFiles", "numOutputRows"))


def test_clustered_places_read_little_for_a_box(spark, tmp_path):
    import random

    rng = random.Random(9)
    rows = [(str(i), (x := rng.uniform(-180, 179), y := rng.uniform(-90, 89), x + 0.001, y + 0.001)) for i in range(20_000)] + [("none", None)]
    table = spark.createDataFrame([(i, b and (b[0], b[2], b[1], b[3])) for i, b in rows], "id string, bbox struct<xmin:double,xmax:double,ymin:double,ymax:double>")
    P.write_clustered(table, str(tmp_path / "c"), 16 << 10)
    kind = "id STRING, bbox STRUCT<xmin: DOUBLE, xmax: DOUBLE, ymin: DOUBLE, ymax: DOUBLE>"
    read = {}
    for name, box in (("globe", (-180.0, -90.0, 180.0, 90.0)), ("large", (-31.0, -16.0, 44.0, 29.0)), ("small", (-3.0, 4.0, 2.0, 6.0)), ("edge", (165.0, 75.0, 179.5, 89.5))):
        frame = P.read_box(spark, str(tmp_path / "c"), box, kind)
        read[name] = scanned(frame)
        x0, y0, x1, y1 = box
        assert {r.id for r in frame.collect()} == {i for i, b in rows if b and b[0] > x0 - 0.01 and b[2] < x1 + 0.01 and b[1] > y0 - 0.01 and b[3] < y1 + 0.01}
    assert read["small"][0] < read["large"][0] < read["globe"][0] / 4 and read["small"][1] < read["large"][1] / 4 < read["globe"][1] / 16


def test_merges_touch_only_their_buckets(spark, tmp_path):
    import os

    from orgatlas.operators import history as H

    path, columns = str(tmp_path / "kept"), "`id` string, `version` bigint, `note` string"
    frame = lambda rows: spark.createDataFrame(rows, columns)
    files = lambda: {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}
    H.merge_into(frame([(f"k{i}", 1, "first") for i in range(300)] + [("k0", 0, "older"), (None, 1, "nobody")]), path)
    before = files()
    touched = H.merge_into(frame([("k7", 2, "second"), ("k8", 0, "too old"), ("new", 1, "x")]), path)
    kept = {f for f, at in files().items() if before.get(f) == at}
    assert len(touched) <= 3 and len(before) - len(kept) in (len(touched), len(touched) - 1) and len(kept) > 50  # the new key's bucket may have been empty
    got = {r.id: (r.version, r.note) for r in H.read_kept(spark, path, columns).collect()}
    assert len(got) == 301 and got["k7"] == (2, "second") and got["k8"] == (1, "first") and got["k0"] == (1, "first") and got["new"] == (1, "x")
    assert [r.note for r in H.read_kept(spark, path, columns, only="k7").collect()] == ["second"]
    ids = spark.createDataFrame([(f"k{i}",) for i in range(300)] + [("absent",), (None,)], "id string")
    H.delete_from(spark, path, columns, ids)
    assert [r.id for r in H.read_kept(spark, path, columns).collect()] == ["new"]
    H.merge_into(frame([("k7", 1, "back")]), path)
    assert sorted(r.id for r in H.read_kept(spark, path, columns).collect()) == ["k7", "new"]
    assert H.merge_into(frame([]), path) == [] and H.read_kept(spark, path, columns).count() == 2
