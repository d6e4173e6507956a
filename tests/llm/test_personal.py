"""Problem 10 on sentences of their own wording; reliabilities on simulated labelers."""

import random

from pyspark.sql import functions as F

from tessera.llm import personal

#: Ordinary sentences with what they hold; the wording is that of no table.
HELD_OUT = {
    "Yesterday Dr. Priya Natarajan told reporters that the trial had ended; write to p.natarajan@clinic.example for details.": [("name", "Priya Natarajan"), ("email", "p.natarajan@clinic.example")],
    "Sophie Turner was born in Leeds and now lives at 14 Rosebery Avenue, London.": [("name", "Sophie Turner"), ("street_address", "14 Rosebery Avenue")],
    "Please call Emily Johnson on 020 7946 0958 before noon.": [("name", "Emily Johnson"), ("phone", "020 7946 0958")],
    "My landlord Wei Zhang can be reached at 555 123 4567.": [("name", "Wei Zhang"), ("phone", "555 123 4567")],
    "She showed her passport number 533380006 at the desk.": [("id_number", "533380006")],
    "Her social security number is 123-45-6789, she said.": [("id_number", "123-45-6789")],
    "You may ring (212) 555-0187 at any time.": [("phone", "(212) 555-0187")],
    "National Insurance number QQ 12 34 56 C was stamped on the card.": [("id_number", "QQ 12 34 56 C")],
    "Mobile: 07700 900123. Home: 8 Mill Lane, Ely.": [("phone", "07700 900123"), ("street_address", "8 Mill Lane")],
    "The plumber José García (jose.garcia@fontaneros.example) works on Saturdays.": [("name", "José García"), ("email", "jose.garcia@fontaneros.example")],
    "According to Omar Haddad, +44 20 7946 0991 is no longer in use.": [("name", "Omar Haddad"), ("phone", "+44 20 7946 0991")],
    "Herr Klaus Weber wohnt Lindenstraße 12 in Bonn.": [("name", "Klaus Weber"), ("street_address", "Lindenstraße 12")],
    "Madame Claire Dupont demeure 5, rue de Rivoli à Paris.": [("name", "Claire Dupont"), ("street_address", "5, rue de Rivoli")],
    "Carmen Ortega vive en Calle Mayor 7, tel. +34 912 555 010.": [("name", "Carmen Ortega"), ("street_address", "Calle Mayor 7"), ("phone", "+34 912 555 010")],
    "Mr. Thomas O'Brien signed for the parcel.": [("name", "Thomas O'Brien")],
    "The report was written by Laura Bianchi in the spring.": [("name", "Laura Bianchi")],
    "Photographer: Hiroshi Tanaka": [("name", "Hiroshi Tanaka")],
    "Questions go to Maria van der Berg, m.berg [at] post [dot] example.": [("name", "Maria van der Berg"), ("email", "m.berg [at] post [dot] example")],
    "Nurse Fatima El-Sayed asked for DNI 12345678Z.": [("name", "Fatima El-Sayed"), ("id_number", "12345678Z")],
    "Walker, James, 22 Abbey Road, phone 555-010-7788.": [("name", "Walker, James"), ("street_address", "22 Abbey Road"), ("phone", "555-010-7788")],
    "The teacher Paul Lindqvist retired in June.": [("name", "Paul Lindqvist")],
    "His widow Rosa Moreau lived at 3 Church Street until then.": [("name", "Rosa Moreau"), ("street_address", "3 Church Street")],
    "Sincerely, Andrew Patel": [("name", "Andrew Patel")],
    "Interviewed: Nina Petrova, nina@petrova.example": [("name", "Nina Petrova"), ("email", "nina@petrova.example")],
    "Dr. J. R. Whitfield said the dose was right.": [("name", "J. R. Whitfield")],
}
#: Sentences with nothing personal in them.
PLAIN = [
    "The James River flows past Richmond Bridge into the sea.", "In 1984 Victoria Station was rebuilt, see ISBN 978-3-16-148410-0, page 212.", "Saint Peter Church stands on Market Square.", "Order no. 4471-2233-9 was shipped to the warehouse.",
    "Mary Poppins Theatre opened in 1962 near King Street.", "The grid reference is 51.50, 12.12 and the height 1452 m.", "Catalogue number KX 1904839 lists 12 maps.", "The Thomas Memorial Library holds 40,000 books.", "New York is larger than San Diego.", "Version 10.4.2 follows 10.4.1.",
]


def test_held_out(spark):
    rows = [(k, text) for k, text in enumerate([*HELD_OUT, *PLAIN, "", None])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("kind", F.lit("clash"))
    found = personal.spans(df).cache()
    got: dict = {}
    for r in found.collect():
        assert rows[r["doc_id"]][1][r["start"] : r["stop"]] == r["found_text"]
        got.setdefault(r["doc_id"], set()).add((r["kind"], r["found_text"]))
    want = {k: set(w) for k, w in enumerate(HELD_OUT.values())}
    hit = sum(len(got.get(k, set()) & w) for k, w in want.items())
    missed = [(k, x) for k, w in want.items() for x in w - got.get(k, set())]
    false = [(k, x) for k, g in got.items() for x in g - want.get(k, set())]
    assert hit >= 0.9 * sum(map(len, want.values())), missed
    assert len(false) <= 0.1 * hit, false
    red = {r["doc_id"]: (r["text"], r["n_replaced"]) for r in personal.redacted(df).collect()}
    assert red[len(rows) - 2] == ("", 0) and red[len(rows) - 1] == (None, 0)
    for k, text in rows:
        if text:
            spans = sorted((r["start"], r["stop"], r["kind"]) for r in found.filter(F.col("doc_id") == k).collect()) if k < 4 else None
            if spans is not None:
                at, made = 0, ""
                for a, b, kind in spans:
                    made, at = made + text[at:a] + personal.PLACEHOLDERS[kind], b
                assert red[k] == (made + text[at:], len(spans))
    assert personal.spans(df.limit(0)).count() == 0


def test_long_text_and_repeated_rows(spark):
    text = "x " * 200_000 + "mail me: a.b@mail.example"
    got = personal.spans(spark.createDataFrame([(1, text), (1, text)], "doc_id long, text string")).collect()
    assert [r["found_text"] for r in got] == ["a.b@mail.example"] * 2


def test_reliabilities():
    r = random.Random(3)
    counts, truth = {}, {}
    for _ in range(20_000):
        t = r.random() < 0.4
        v = tuple((1 if (r.random() < good) == t else -1) if r.random() < 0.8 else 0 for good in (0.95, 0.9, 0.8, 0.55))
        counts[v] = counts.get(v, 0) + 1
        truth[v] = truth.get(v, 0) + t
    post = personal.reliabilities(counts)
    wrong = sum(min(counts[v] - truth[v], counts[v]) if post[v] >= 0.5 else truth[v] for v in counts)
    majority = sum(counts[v] - truth[v] if sum(v) > 0 else truth[v] for v in counts)
    assert wrong < majority


def test_forms_of_names():
    given = frozenset({"maria", "helen", "anna"})
    for text, want in {
        "Anna Maria Korr": {"Anna Maria", "Maria Korr"}, "see Anna K. van der Korr-Berg there": {"Anna K. van der Korr-Berg"}, "ANNA VAN KORR": {"ANNA VAN KORR"}, "van der Korr, Anna K. was": {"van der Korr, Anna K."}, "KORR, MARIA": {"KORR, MARIA"},
        "ask helen korrman now": {"helen korrman"}, "von korrman, helen": {"von korrman, helen"}, "J. R. Korr": {"J. R. Korr"}, "D'Anna Korr": {"D'Anna Korr"}, "one Word, Here": {"Word, Here"},
    }.items():
        assert {text[c[0] : c[1]] for c in personal.name_candidates(text, given)} == want, text


def test_phones_come_from_everywhere():
    r = random.Random(2)
    texts = ["Ring 0221/1234567 or 0301/12345678.", "1 2 3 4 5 6 7 8 9 10 11 12 13 14 15 16 17 18 19 20 (631) 555-0107, +49 (221) 12345 12345 12345 12345 12345", "+1 23", "(258.555.0106)", "(01632 960733)"]
    texts += ["".join(r.choices("0123456789 ()+-./,x", [4, *[2] * 9, 5, 1, 1, 1, 2, 2, 1, 1, 1], k=300)) for _ in range(300)]
    for text in texts:
        assert [m.span() for m in personal._matches("phone", text)] == [m.span() for m in personal._PHONE.finditer(text)], text


def test_check_digits():
    assert personal.valid_isbn("9783161484100") and personal.valid_isbn("0306406152") and not personal.valid_isbn("9783161484101") and not personal.valid_isbn("123")


def test_names_beyond_the_broadcast_bound(spark, monkeypatch):
    texts = [*HELD_OUT, *PLAIN, "Ms. Zelda Quimb was born here.", "Call Zelda Quimb on +1 617 555 0121", "The author Zelda Quimb lives at 3 Low Road.", "Zelda Korr was here. L'Quimb 'Zelda Quimb' O’Quimb", "The vale of Zelda Quimb"]
    df = spark.createDataFrame([(k % len(texts), texts[k % len(texts)]) for k in range(3 * len(texts))], "doc_id long, text string")
    listed = {tuple(r) for r in personal.gazetteer(df).collect()}
    assert {("zelda", "given"), ("quimb", "surname")} <= listed
    want = sorted(map(tuple, personal.spans(df).collect()))
    monkeypatch.setattr(personal, "MAX_NAMES", 1)
    assert sorted(map(tuple, personal.spans(df).collect())) == want
    assert {tuple(r) for r in personal.gazetteer(df).collect()} == listed
    assert any(found == "Zelda Quimb" for *_, found in want)
