import pytest

from weakloom.functions.stem import stem_words

# Word and stem pairs of the published sample vocabulary and of the algorithm's description.
PAIRS = """
consign consign|consigned consign|consigning consign|consignment consign|consist consist
consisted consist|consistency consist|consistent consist|consistently consist|consisting consist
consists consist|consolation consol|consolations consol|consolatory consolatori|console consol
consoled consol|consoles consol|consolidate consolid|consolidated consolid|consolidating consolid
consoling consol|consolingly consol|consols consol|consonant conson|consort consort
consorted consort|consorting consort|conspicuous conspicu|conspicuously conspicu
conspiracy conspiraci|conspirator conspir|conspirators conspir|conspire conspir|conspired conspir
conspiring conspir|constable constabl|constables constabl|constance constanc|constancy constanc
constant constant|knack knack|knackeries knackeri|knacks knack|knag knag|knave knave|knaves knave
knavish knavish|kneaded knead|kneading knead|knee knee|kneel kneel|kneeled kneel|kneeling kneel
kneels kneel|knees knee|knell knell|knelt knelt|knew knew|knick knick|knif knif|knife knife
knight knight|knightly knight|knights knight|knit knit|knits knit|knitted knit|knitting knit
knives knive|knob knob|knobs knob|knock knock|knocked knock|knocker knocker|knockers knocker
knocking knock|knocks knock|knopp knopp|knot knot|knots knot
generate generat|generates generat|generated generat|general general|generally general
generic generic|generically generic|generous generous|generously generous|arsenal arsenal
skis ski|skies sky|dying die|lying lie|tying tie|news news|innings inning|proceed proceed
exceeds exceed|succeeding succeed|gas gas|this this|gaps gap|kiwis kiwi|ties tie|cries cri
hopping hop|hoping hope|luxuriated luxuri|cry cri|by by|say say|happy happi|provide provid
provides provid|providing provid|allocation alloc|allocate alloc|budget budget|penalty penalti
penalties penalti|levy levi|levies levi|seize seiz|finance financ|financing financ|financial financi
resource resourc|resources resourc|increase increas|concessional concession|commitment commit
beautiful beauti|communism communism|hopefulness hope|national nation|rational ration
relational relat|formalize formal|electricity electr|electrical electr|goodness good
a a|as as|is is|youth youth|yes yes|enjoy enjoy|boy boy|bed bed|agreed agre|feed feed|fee fee
""".replace("\n", "|")


def test_published_pairs(spark):
    pairs = [p.split() for p in PAIRS.split("|") if p.strip()]
    frame = spark.createDataFrame([(w, s) for w, s in pairs], "word string, want string")
    rows = stem_words(frame, "word", "stem").collect()
    assert len(rows) == len(pairs)
    assert [(r.word, r.want, r.stem) for r in rows if r.want != r.stem] == []


def test_prefix_filter_keeps_every_form(spark):
    import re

    from weakloom.functions.tokens import prefix_pattern
    for word, stem in (p.split() for p in PAIRS.split("|") if p.strip()):
        assert re.match(prefix_pattern([stem]), word), (word, stem)


@pytest.mark.parametrize("word", ["", "e", "ée", "ß", "año", "x1_2"])
def test_odd_words_pass_through(spark, word):
    frame = spark.createDataFrame([(word,)], "word string")
    assert stem_words(frame, "word", "stem").collect()[0].stem is not None


def test_first_letters_lose_no_form(spark):
    """Forms made of word heads and all suffixes: none is dropped by its first letters before it is stemmed."""
    from pyspark.sql import functions as F

    from weakloom.functions import tokens as tk
    from weakloom.functions.stem import STEP2, STEP3, STEP4, stem_array, stem_words

    heads = ["fin", "budg", "possib", "lie", "die", "ty", "dy", "conn", "relat", "hop", "hopp", "cr", "sk", "gener", "univers", "y", "happ", "genome", "appliance", "adi", "formaliz"]
    suffixes = ["", "s", "es", "ies", "ied", "y", "e", "ed", "ing", "ly", "edly", "ingly", "bility", "ability", "ators", "ble", "ings", *STEP2, *STEP3, *STEP4]
    words = sorted({h + a + b for h in heads for a in suffixes for b in ("", "s", "ing", "li")})
    frame = spark.createDataFrame([(w,) for w in words], "word string")
    rows = stem_words(frame, "word", "stem").collect()
    import re
    assert not [r for r in rows if r.stem and not re.match(tk.prefix_pattern([r.stem]), r.word)]
    array = frame.select(stem_array(F.array(F.struct("word", F.lit(7).alias("at")))).alias("a"), "word").select("word", F.get("a", 0).alias("x"))
    assert {r.word: r.x.word for r in array.collect()} == {r.word: r.stem for r in rows}


def test_forms_hold_every_word_of_a_stem(spark):
    """Random words with up to three endings: each is among the forms of its stem, and passes the test for that stem."""
    import random

    from pyspark.sql import functions as F

    from weakloom.functions.forms import common_forms, forms_of, may_have_stem, stem_of
    from weakloom.functions.stem import IRREGULAR, STEP2, STEP3, STEP4

    dice = random.Random(7)
    endings = ["", "", "s", "es", "ies", "ied", "y", "e", "ed", "ing", "ly", "edly", "ingly", "eed", "eedly", "ll", "ble", *STEP2, *STEP3, *STEP4]
    heads = ["gener", "commun", "arsen", "y", "sk", "budg", "financ", "possib", "año", "hopp", "sayy", *IRREGULAR]
    words = set(IRREGULAR)
    while len(words) < 1500:
        head = dice.choice(heads) if dice.random() < 0.3 else "".join(dice.choice("aeiouybdglnrstté") for _ in range(dice.randint(0, 6)))
        words.add(head + "".join(dice.choice(endings) for _ in range(dice.randint(0, 3))))
    frame = spark.createDataFrame([(w,) for w in sorted(words)], "word string")
    stems = {r.word: r.stem for r in stem_words(frame, "word", "stem").collect()}
    assert [w for w, s in stems.items() if w not in forms_of(s)] == []
    some = sorted(set(stems.values()))[::20]
    table = {w: stems[w] for w in common_forms(some) if w in stems}
    found = frame.select("word", may_have_stem(some)(F.col("word")).alias("may"), stem_of(table)(F.col("word")).alias("stem")).collect()
    assert not [r for r in found if stems[r.word] in some and not r.may]
    assert sum(r.may for r in found if stems[r.word] not in some) < len(found) / 20
    assert {r.word: r.stem for r in found if r.stem is not None} == table


def test_rows_send_only_rare_forms_to_the_stemmer(spark):
    """Tokens that merely begin like a phrase word are dropped by a look-up; common forms come with their stem."""
    from pyspark.sql import functions as F

    from weakloom.functions import tokens as tk
    from weakloom.operators import labeling as lb

    lexicon = lb.stemmed_lexicon(spark, {"g": ["finance", "with", "in the"]})
    text = "financing withe within withal financon innin ination theing theories these the finances allocation financizations in"
    frame = spark.createDataFrame([(text,), ("",), (None,)], "text string").select(tk.tokens(F.col("text")).alias("_tokens"))
    likely = frame.select(tk.likely_occurrences("_tokens", lexicon.words, lexicon.forms).alias("_likely"))
    done = likely.select("_likely", tk.stem_forms("_likely", lexicon.words).alias("_forms"))
    rows = done.select("_likely", "_forms", tk.stem_occurrences("_likely", "_forms").alias("hits")).collect()
    assert rows[0]["_forms"] == {"financizations": "financ"}
    stems = stem_words(spark.createDataFrame([(t,) for t in sorted(set(text.split()))], "word string"), "word", "stem").collect()
    stems = {r.word: r.stem for r in stems}
    want = [(stems[t], i) for i, t in enumerate(text.split()) if stems[t] in lexicon.words]
    assert len(want) == 7 and [(h.word, h.at) for h in rows[0].hits] == want
    assert {x.word for x in rows[0]["_likely"]}.isdisjoint({"within", "ination", "theories", "allocation"})
    assert rows[1].hits == rows[2].hits == []
    assert lb.with_occurrences(spark.createDataFrame([("a b",)], "text string"), "text", lb.stemmed_lexicon(spark, {"g": []})).first()["_hits"] is None


def test_join_shuffles_only_likely_tokens(spark):
    from weakloom.operators import stemming

    frame = spark.createDataFrame([(1, "financing within theories"), (2, "x")], "doc_id long, text string")
    stems = stemming.stem_table(spark, ["finance"])
    found = stemming.occurrences_by_join(frame, "doc_id", "text", stemming.surface_forms(frame, "text", stems), stems.values())
    assert [(r.doc_id, [tuple(h) for h in r.hits]) for r in found.collect()] == [(1, [("financ", 0)])]
