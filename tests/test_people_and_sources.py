import json

import pytest

from civicledger.operators import audit as A, resolve as E
from civicledger.sources import bars as SB, disclosures as SD, resolutions as SR, reviewed as RV, roster as SO
from civicledger.streaming.ingest import TradeStore, ingest_stream, page_stream

ROSTER = "bioguide_id string, first_name string, middle_name string, last_name string, chamber string, state string, aliases array<string>, district string"


def member(i, first, middle, last, chamber="house", state="NY", aliases=None, district="1"):
    return (i, first, middle, last, chamber, state, aliases, district)


def test_names_match_conservatively(table):
    roster = table(ROSTER, member("A1", "José", "J.", "Núñez"), member("A2", "Kelly", None, "Morrison"), member("A3", "David", "J.", "Taylor"),
                   member("A4", "Ann", None, "Lee"), member("A5", "Ann", None, "Lee", state="TX"), member("A6", "Daniel", None, "Ray", aliases=["Dan Ray"]),
                   member("A7", "Carol", "D.", "Miller", chamber="senate"), member("A8", "Tom", "Mary Ann", "Fox"))
    people = table("id long, name string, chamber string, state string", (1, "Jose Nunez Jr.", "house", None), (2, "Kelly Louise Morrison", "house", None),
                   (3, "David Q. Taylor", "house", None), (4, "Ann Lee", "house", None), (5, "Ann Lee", "house", "tx"), (6, "Dan Ray", "house", None),
                   (7, "Carol Devine Miller", "senate", None), (8, "Carol Evan Miller", "senate", None), (9, "Kelly Morrison", "senate", None),
                   (10, "Tom Mary Ann Fox", "house", None), (11, "Tom Mary Fox", "house", None), (12, "Zed", "house", None))
    got = {r.id: (r.status, r.method, r.bioguide_id, r.same_surname) for r in E.match_politicians(people, roster).collect()}
    exact, extra = "exact_name+chamber", "name_with_extra_middle+chamber"
    assert got == {1: ("matched", exact, "A1", None), 2: ("matched", extra, "A2", None), 3: ("unmatched", None, None, 1), 4: ("ambiguous", None, None, None),
                   5: ("matched", exact, "A5", None), 6: ("matched", exact, "A6", None), 7: ("matched", extra, "A7", None), 8: ("unmatched", None, None, 1),
                   9: ("unmatched", None, None, 0), 10: ("matched", exact, "A8", None), 11: ("unmatched", None, None, 1), 12: ("unmatched", None, None, 0)}


def test_an_official_belongs_to_one_politician(table):
    people = table("id long, bioguide_id string", (1, None), (2, None), (3, "B"), (4, "Z"), (5, None))
    matches = table("id long, bioguide_id string", (1, "A"), (2, "A"), (3, "B"), (4, "Y"), (5, "B"))
    got = {r.id: (r.status, r.note) for r in E.ownership_conflicts(matches, people).collect()}
    assert got == {1: ("matched", None), 2: ("conflict", "belongs to another politician"), 3: ("matched", None),
                   4: ("conflict", "linked to another official"), 5: ("conflict", "belongs to another politician")}


def test_tickers_are_looked_up_in_order(table):
    secs = table("ticker string", ("BRK.B",), ("DUP",), ("OLD",), ("NEW",))
    full = table("cik string, name string, ticker string, exchange string, position int", ("1", "B", "brk-b", "NYSE", 0), ("2", "D", "DUP", None, 1), ("3", "D", "DUP", None, 2))
    plain = table("ticker string, cik string", ("old", "7"), ("DUP", "2"), ("old", "7"))
    got = {r.ticker: (r.ciks, r.cik) for r in E.ticker_lookup(secs, full, plain).collect()}
    assert got == {"BRK.B": (1, 1), "DUP": (2, 2), "OLD": (1, 7)}


def write(folder, name, text):
    path = folder / name
    path.write_text(text if isinstance(text, str) else json.dumps(text))
    return str(path)


def test_member_and_registrant_files(spark, tmp_path):
    term = lambda c, s, e=None: {"chamber": c, "startYear": s, **({"endYear": e} if e else {})}
    members = write(tmp_path, "m.json", {"members": [
        {"bioguideId": "L000001", "name": "Lee, Ann Marie, Jr.", "partyName": "Democratic", "state": "Ohio", "district": 0,
         "terms": {"item": [term("House of Representatives", 2001), term("Senate", 1990, 1996)]}},
        {"bioguideId": "L000002", "name": "Lee", "firstName": "Bo", "lastName": "Lee", "state": "tx", "terms": [term("Senate", 2001, 2007)]},
        {"bioguideId": "", "name": "No, One", "terms": []}, {"bioguideId": "L000003", "name": "No, Term", "terms": []}]})
    a, b = SO.read_members(spark, members).orderBy("bioguide_id").collect()
    assert (a.first_name, a.middle_name, a.last_name, a.suffix, a.chamber, a.party, a.state, a.district, a.active) == (
        "Ann", "Marie", "Lee", "Jr.", "house", "D", "OH", "At Large", True)
    assert (b.first_name, b.last_name, b.chamber, b.state, b.district, b.active, b.term_end_year) == ("Bo", "Lee", "senate", "TX", None, False, 2007)
    full = SO.read_registrants(spark, write(tmp_path, "t.json", {"fields": ["cik", "name", "ticker", "exchange"], "data": [[320, "Apple", "AAPL", "Nasdaq"], [1, None]]}))
    assert [(r.cik, r.ticker) for r in full.collect()] == [("320", "AAPL"), ("1", None)]
    assert [tuple(r) for r in SO.read_registrant_text(spark, write(tmp_path, "t.txt", "aapl\t320\nbad line here\nx y\n")).collect()] == [("aapl", "320")]


CLERK = """<MemberData publish-date="March 1, 2026"><title-info><congress-num>119</congress-num></title-info><members>
<member><member-info><bioguideID>L1</bioguideID><firstname>Ann</firstname><lastname>Lee</lastname><official-name>Ann Lee</official-name><party>D</party>
<state postal-code="OH"><state-fullname>Ohio</state-fullname></state><district>1st</district><sworn-date date="20250103">x</sworn-date><prior-congress>118</prior-congress></member-info>
<committee-assignments><committee comcode="AG00" rank="3"/><subcommittee subcomcode="AG15" leadership="Chair"/><committee comcode="ZZ99"/></committee-assignments></member>
<member><member-info><bioguideID></bioguideID><state postal-code="TX"><state-fullname>Texas</state-fullname></state></member-info>
<predecessor-info><pred-firstname>Bo</pred-firstname><pred-lastname>Lee</pred-lastname></predecessor-info><committee-assignments/></member></members>
<committees><committee comcode="AG00"><committee-fullname>Committee on Agriculture</committee-fullname><subcommittee subcomcode="AG15"><subcommittee-fullname>Forestry</subcommittee-fullname></subcommittee></committee></committees></MemberData>"""


def test_clerk_snapshot(spark, tmp_path):
    doc = SO.read_clerk_roster(spark, write(tmp_path, "clerk.xml", CLERK))
    people = SO.clerk_members(doc).collect()
    assert [(p.bioguide_id, p.last_name, p.prior_congress) for p in people] == [("L1", "Lee", 118), (None, "Lee", None)]
    seats = {(r.committee_code, r.subcommittee_code): (r.role, r.congress_number, str(r.verified_through)) for r in SO.clerk_seats(doc).collect()}
    assert seats == {("AG00", None): ("Member", 119, "2026-03-01"), ("AG00", "AG15"): ("Chair", 119, "2026-03-01")}


RESOLUTION = """<resolution><form><action><action-desc>In the House of Representatives, U. S., January 16, 2025.</action-desc></action></form><resolution-body><section>
<text>That the following Members be, and are hereby, elected to the following standing committees of the House:</text>
<paragraph><header>Committee on <italic>Agriculture</italic>: </header><text>Ms. Lee of Ohio (to rank immediately after Mr. X), Mr. Bo Lee, Mr. Fox, Chair, the Clerk.</text></paragraph>
<paragraph><header>Committee on Magic</header><text>Mr. Fox.</text></paragraph></section></resolution-body></resolution>"""


def test_resolutions_place_names_or_set_them_aside(spark, table):
    docs = table("label string, url string, xml string", ("R1", "u", RESOLUTION), ("R2", "u", RESOLUTION.replace("In the House of", "Draft in")), ("R3", "u", "<x/>"))
    people = table("bioguide_id string, first_name string, last_name string, official_name string, state_name string, sworn date, prior_congress int",
                   ("L1", "Ann", "Lee", "Ann Lee", "Ohio", None, 0), (None, "Bo", "Lee", "Bo Lee", "Texas", None, None),
                   ("F1", "Al", "Fox", "Al Fox", "Utah", None, 0), ("F2", "Ed", "Fox", "Ed Fox", "Iowa", None, 0))
    committees = table("committee_code string, committee_name string", ("AG00", "Committee on Agriculture"))
    events, report = SR.committee_events(docs, people, committees, 119)
    assert [(e.bioguide_id, e.committee_code, str(e.date), e.verb) for e in events.collect()] == [("L1", "AG00", "2025-01-16", "elected")]
    assert {(r.name or r.odd): r.outcome for r in report.filter("committee_code IS NOT NULL").collect()} == {
        "Lee": "event", "Bo Lee": "unresolved", "Fox": "ambiguous", "the Clerk": "odd_segment"}
    assert {r.bioguide_id for r in SR.ambiguous_members(report).collect()} == {"F1", "F2"}
    assert report.filter("outcome = 'unmapped_committee'").count() == 1


def test_bars_drop_days_without_close(table):
    raw = table("ticker string, date date, open double, high double, low double, close double, adj_close double, volume double",
                ("BRK-B", "2026-01-01", 1.0, float("nan"), 1.0, 1.0, float("nan"), 10.0), ("BRK-B", "2026-01-02", 1.0, 1.0, 1.0, float("nan"), 1.0, 1.0))
    (r,) = SB.normalize_bars(raw, table("ticker string", ("BRK.B",))).collect()
    assert (r.ticker, r.high, r.adj_close, r.volume) == ("BRK.B", None, None, 10)


MAPPING_ROW = dict(mapping_id=1, chamber="house", committee_code="X", subcommittee_code=None, committee_name="X", subcommittee_name=None, sic_start="0100",
                   sic_end="0200", industry_pattern=None, relevance_level="direct", rationale="r", jurisdiction_text=None, source_citation=None, source_url="u",
                   reviewed_at=None, mapping_version="v2", review_status="needs_review", reviewed_by=None, review_note=None, jurisdiction_basis="rule_x_text")


@pytest.mark.parametrize("change, problem", [
    ({}, None), ({"rationale": " "}, "missing rationale"), ({"relevance_level": "x"}, "unknown relevance_level"), ({"review_status": "reviewed"}, "reviewed_at must be set exactly for reviewed rows"),
    ({"sic_start": "0300"}, "SIC range needs four-digit codes in order"), ({"sic_start": "100"}, "SIC range needs four-digit codes in order"),
    ({"relevance_level": "none"}, "a 'none' row has no SIC range"), ({"industry_pattern": "(steel"}, "industry_pattern is not usable"),
    ({"subcommittee_code": "S"}, "subcommittee_name needed"), ({"industry_pattern": r"\bsteel\b|iron[(]?"}, None)])
def test_mapping_file_is_all_or_nothing(spark, change, problem):
    from civicledger.schemas import MAPPING

    rows = [tuple(MAPPING_ROW.values()), tuple({**MAPPING_ROW, "mapping_id": 2, **change}.values())]
    loaded, violations = RV.sync_mappings(spark.createDataFrame(rows, MAPPING))
    assert [(v.mapping_id, v.problem) for v in violations.collect()] == ([(2, problem)] if problem else [])
    assert loaded.count() == (0 if problem else 2)


def page(spark, tmp_path, n, *trades):
    write(tmp_path, f"page{n}.json", {"total": 9, "offset": n * 100, "limit": 100, "has_more": False, "trades": list(trades)})


def test_stream_stores_each_line_once(spark, tmp_path):
    rec = {"member": "Ann Lee", "chamber": "House", "trade_type": "buy", "amount": "$1 - $2", "tx_date": "2026-01-05", "disclosed": "2026-01-06", "asset": "Acme", "ticker": "ACM"}
    feed = tmp_path / "feed"
    feed.mkdir()
    store = TradeStore(spark, tmp_path / "tables")

    def run():
        ingest_stream(page_stream(spark, str(feed)), store, tmp_path / "checkpoint", now="2026-01-07 00:00:00").awaitTermination()

    page(spark, feed, 0, rec, rec, {**rec, "chamber": "?"})
    run()
    run()
    page(spark, feed, 1, rec, rec, rec, {**rec, "member": "Bo Ray", "ticker": "XY"})
    run()
    assert store.read("trades").count() == 4 and store.read("rejects").count() == 1
    assert sorted(r.name for r in store.latest("politicians").collect()) == ["Ann Lee", "Bo Ray"]
    # replaying the last batch by hand changes nothing
    from civicledger.streaming.ingest import store_batch
    last = store.batches("trades")[-1]
    store_batch(store, SD.read_pages(spark, str(feed / "page1.json")), last, "disclosure_feed", "2026-01-07 00:00:00")
    assert store.read("trades").count() == 4 and store.latest("securities").count() == 2


FACTS = "trade_id string, numbers array<double>, committees array<struct<committee_name:string,subcommittee_name:string>>, own_names string, flagged boolean"


@pytest.mark.parametrize("summary, problem", [
    ("Nothing here establishes insider trading.", "summary uses insider outside a denial"),
    ("This does not establish insider trading.", None),
    ("The records do not show wrongdoing; yet it is suspicious.", "summary uses suspicio outside a denial"),
    ("The value was 99.7 percent, about $1.5 million.", None),
    ("The value was 99.8 percent.", "summary states 99.8, which was not supplied"),
    ("The Armed Services Committee is involved.", None),
    ("He sits on the Committee on Foreign Affairs.", "summary names a committee that is not in the evidence: affairs foreign"),
    ("Lee's committee seat is current.", None),
    ("This is energy and commerce business.", "summary mentions energy and commerce, which is not in the evidence"),
    ("It is flagged.", "summary speaks of a flag, but the trade is not flagged"),
    ("It is not flagged.", None), ("", "summary is empty")])
def test_explanations_may_only_say_what_is_supplied(spark, table, summary, problem):
    facts = spark.createDataFrame([("t", [99.73, 1500000.0], [("Committee on Armed Services", None)], "Ann Lee Acme", False)], FACTS)
    signals = [(s, "As stored.") for s in ("committee_relevance", "trade_size_anomaly")]
    texts = spark.createDataFrame([("t", "A trade", summary, "Public data.", signals)],
                                  "trade_id string, headline string, summary string, limitations string, signals array<struct<type:string,explanation:string>>")
    known = table("committee_name string", ("Committee on Armed Services",), ("Committee on Energy and Commerce",))
    (r,) = A.explanation_audit(texts, facts, known).collect()
    assert r.problems == ([problem] if problem else [])


def test_a_queue_of_open_cases(table):
    people = table("id long, name string, chamber string, enrichment_status string", (1, "A", "house", "unmatched"), (2, "B", "house", "matched"), (3, "C", "house", None))
    ideas = table("suggestion_id long, politician_id long, selected_bioguide_id string, confidence double, outcome string, reason string",
                  (1, 1, "X", 0.5, "rejected", "r"), (2, 1, "Y", 0.9, "review", None))
    (r,) = E.review_queue(people, ideas).collect()
    assert (r.id, r.suggestion_selected_bioguide_id, r.suggestion_outcome) == (1, "Y", "review")
