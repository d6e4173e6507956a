"""Problems 1 and 7 on small cases."""

from pyspark.sql import functions as F

from tessera.llm import looks, mapping


def test_forms(spark):
    vocabulary = ["inner septum stroma", "type", "δ-cell", "ткань 20", "café"]
    cases = {"іnnеr ѕеptum": "inner septum", "ｓｔｒｏｍａ": "stroma", "café": "café", "sep​tum": "septum", "ΤΟΡ": "ΤΟΡ", "inner ΤΥΡΕ": "inner TYPE", "Δ-CELL": "Δ-CELL", "ткань 20": "ткань 20", "inner‐type": "inner‐type", "inner‑type": "inner‐type", "inner－type": "inner-type", "рaхqz": "рaхqz", "": "", "ﬁn": "fin"}
    df = spark.createDataFrame([(x,) for x in [*vocabulary, *cases, None, "type"]], "text string")
    got = {r["text"]: r["form"] for r in looks.visual_forms(df).collect()}
    assert {k: got[k] for k in cases} == cases and len(got) == len(set(vocabulary) | set(cases))


def test_only_words_as_written_vouch(spark):
    df = spark.createDataFrame([("ѕeptum",), ("sеptum",)], "text string")
    assert {r["form"] for r in looks.visual_forms(df).collect()} == {"ѕeptum", "sеptum"}


def test_mixed_words_of_all_scripts(spark):
    plain = ["protein kidney tissue adipose", "deep rate", "α-protein", "TNF"]
    cases = {"ρrotein": "protein", "κidney": "kidney", "τissue": "tissue", "αdipose": "adipose", "ᏢROTEIN": "PROTEIN", "kiᎠney": "kiDney", "𝐩𝐫𝐨𝐭𝐞𝐢𝐧": "protein", "ᴛissue": "tissue", "α-protein": "α-protein", "τνz": "τνz", "ԁеер rate": "deep rate", "а α-protein": "а α-protein"}
    got = {r["text"]: r["form"] for r in looks.visual_forms(spark.createDataFrame([(x,) for x in [*plain, *cases]], "text string")).collect()}
    assert {k: got[k] for k in cases} == cases


def test_look_up(spark):
    t = spark.createDataFrame([(1, "Inner ѕеptum, "), (2, "inner septum"), (3, "innér septum"), (4, None), (5, "inner-septum")], "target_id long, pre_hz_label string").withColumn("text", F.lit("clash"))
    e = spark.createDataFrame([(7, "label", "inner_septum"), (8, "label", "inner_ѕeptum"), (9, "id", "inner_septum"), (10, "label", None), (11, "label", "inner_septum")], "entry_id long, index_name string, lookup_key string")
    assert {tuple(r) for r in looks.look_up(t, e).collect()} == {(1, 7), (1, 8), (1, 11), (2, 8)}
    assert looks.look_up(t.limit(0), e).count() == 0


NOTES = sorted([("sample",), ("orig",), ("free", "text"), ("probably",), ("?", "#")], key=lambda r: -len(r))


def test_word_checks():
    w = mapping.words_of
    cost = lambda a, b: mapping.value_cost(w(a), w(b), NOTES)
    for good in ("Growth  STAGE", "stage, growth", "gorwth stagge", "growthStage", "grow. stage", "sample growth stage", "growth stage (free text)", "growth stage [1]", "growth-stage_orig", "grоwth\u200b stage", "probably growth stage; n=3"):
        assert cost(good, "growth stage") is not None, good
    for bad in ("growth", "growth phase", "growth stage two", "early growth stage", "stage", "", "growth stage 2", "time stage"):
        assert cost(bad, "growth stage") is None, bad


def table(spark, texts):
    return spark.createDataFrame([(k, t, []) for k, t in enumerate(texts)], "ref_id long, canonical string, aliases array<string>")


def test_mapping(spark):
    ref = spark.createDataFrame([(1, "field", "growth stage", ["maturity"]), (2, "field", "donor age", None), (3, "label", "deep plexus", []), (4, "field", None, [None]), (5, "field", "growth stages", [])], "ref_id long, kind string, canonical string, aliases array<string>")
    t = spark.createDataFrame([(1, "growth stage", "plexus deep"), (2, "Maturity*", "deep plexus"), (3, "dnor age", None), (4, None, "deep lexus"), (5, "", "other thing"), (6, "growth stage ", "???")], "target_id long, pre_hz_field string, pre_hz_label string").withColumn("words", F.lit(1))
    got = {(r["target_id"], r["kind"]): (r["ref_id"], r["status"]) for r in mapping.mapped(t, ref).collect()}
    assert got == {(1, "field"): (1, "exact"), (2, "field"): (1, "mapped"), (3, "field"): (2, "mapped"), (5, "field"): (None, "unmatched"), (6, "field"): (1, "mapped"),
                   (1, "label"): (3, "mapped"), (2, "label"): (3, "exact"), (4, "label"): (3, "mapped"), (5, "label"): (None, "unmatched"), (6, "label"): (None, "unmatched")}
    assert mapping.mapped(t.limit(0), ref).count() == 0 and mapping.mapped(t, ref.limit(0)).filter("ref_id is not null").count() == 0


def test_remarks_are_learned(spark):
    """Remarks of no list anywhere: what stands beside many entries is a remark, what stands beside few belongs to the value."""
    organs = ["lung", "liver", "kidney cortex", "spleen", "brain stem", "heart valve", "colon", "retina"]
    phrases = ["(suspected)", ", see comment", "- duplicate", "as stated", "unspecified", "specimen", "tube 7", "aliquot c"]
    typed = {f"{o} {p}": k for i, p in enumerate(phrases) for k, o in enumerate(organs) if (i + k) % 2 == 0}
    typed |= {"lung cancer": None, "lung lobe": None, "spleen specimen tube 12": 3, "colon aliquot q": 6, "heart valve 7": None}
    got = {r["value"]: r["ref_id"] for r in mapping.map_values(spark.createDataFrame([(v,) for v in typed], "value string"), table(spark, organs)).collect()}
    assert {v: got.get(v) for v in typed} == typed


def test_words_of_their_own_are_no_slips(spark):
    """Whole words that look like a listed one stay apart: frequent ones and those of the list; rare ones are slips."""
    values = [("liver",)] * 400 + [("river",)] * 60 + [("grain",)] * 45 + [("brain",)] * 90 + [("livr",)] * 3 + [("brian",)] * 2 + [("house",), ("mouse",), ("cat",)]
    got = {r["value"]: r["canonical"] for r in mapping.map_values(spark.createDataFrame(values, "value string"), table(spark, ["liver", "brain", "mouse", "house", "rat"])).collect()}
    assert got == {"liver": "liver", "brain": "brain", "livr": "liver", "brian": "brain", "mouse": "mouse", "house": "house", "cat": "rat"}


def test_prefixes_meet_all_similar_words(spark):
    import random

    r = random.Random(5)
    letters = "abcdefghiklmnoprstu"
    word = lambda a, b: "".join(r.choices(letters, k=r.randint(a, b)))
    meant = sorted({"condition", "xyzwvqy", "organism", "preservation", "aaaa", "abab", "a", "of", "age", *(word(3, 14) for _ in range(120))})

    def slip(s):
        i = r.randrange(0, len(s))
        return r.choice([s[:i] + s[i + 1 :], s[:i] + r.choice(letters) + s[i:], s[:i] + r.choice(letters) + s[i + 1 :], s[: max(0, i - 1)] + s[i : i + 1] + s[max(0, i - 1) : i] + s[i + 1 :]])

    typed = sorted({x for w in meant for x in (w, w[:3], w[:5], w[: len(w) // 2], *(slip(w) for _ in range(6)), *(slip(slip(w)) for _ in range(6) if len(w) > 1)) if x})
    frame = lambda words: spark.createDataFrame([("w", w) for w in words] + [("j", w) for w in words if len(w) >= 6], "kind string, unit string")
    got = {(x["kind"], x["unit"], x["meant"]) for x in mapping.similar_words(frame(typed), frame(meant)).collect()}
    want = {("w", a, b) for a in typed for b in meant if mapping.word_cost(a, b) is not None}
    want |= {("j", a, b) for a in typed for b in meant if min(len(a), len(b)) >= 6 and mapping.slips(a, b, mapping.joined_slips(len(b))) <= mapping.joined_slips(len(b))}
    assert got == want and len(want) > 1000


def test_join_finds_all_that_brute_force_finds(spark):
    import random

    r = random.Random(5)
    letters = "abcdefghiklmnoprstu"
    word = lambda: "".join(r.choices(letters, k=r.randint(4, 14)))
    entries = ["organism", "preservation", "genetic background", "stupiondum duct", "cell type", "of age", *(" ".join(word() for _ in range(r.randint(1, 3))) for _ in range(50))]

    def slip(s):
        i = r.randrange(1, max(2, len(s) - 1))
        return r.choice([s[:i] + s[i + 1 :], s[:i] + r.choice(letters) + s[i:], s[:i] + r.choice(letters) + s[i + 1 :], s[: i - 1] + s[i : i + 1] + s[i - 1] + s[i + 1 :]])

    def typed(s):
        words = [r.choice([w, w[: r.randint(3, max(3, len(w)))], slip(w), slip(slip(w))]) for w in s.split()]
        r.shuffle(words)
        return r.choice([" ".join(words), "".join(words), " ".join([*words, "sample"]), slip(slip(s.replace(" ", ""))), "sample" + s.replace(" ", ""), s[:3] + " " + s[3:]])

    values = sorted({"org", "pres", "gen bac", "stu duoct", *(typed(t) for t in entries for _ in range(20))})
    got = {x["value"] for x in mapping.map_values(spark.createDataFrame([(v,) for v in values], "value string"), table(spark, entries), remarks=["sample"]).collect()}
    listed = {w for t in entries for w in t.split()}
    cost = lambda w, m: None if w != m and w in listed else mapping.word_cost(w, m)
    want = {v for v in values if any(mapping.value_cost(mapping.words_of(v), mapping.words_of(t), [("sample",)], cost) is not None for t in entries)}
    assert got == want and {"org", "pres", "gen bac", "stu duoct"} <= got and len(want) > 500
