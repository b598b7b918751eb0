import os
import random

import pytest

from tonearm.llm import leakage, packing, privacy


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


WORDS = [f"{a}{b}{c}" for a in "bdfgklmnprstvz" for b in "aeiou" for c in ("n", "ral", "stor", "vik")]


def test_leaks(spark):
    rng = random.Random(1)
    stock = "Answer in a single sentence without repeating the question."
    passages = [f"{stock if i % 2 else ''} " + " ".join(rng.choice(WORDS) for _ in range(80)) for i in range(6)]
    w = [p.split() for p in passages]
    filler = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    changed = list(w[2])
    for k in range(5, 80, 17):
        changed[k] = "other"
    docs = {
        1: f"{filler(200)} {passages[0]} {filler(10)}", 2: f"{filler(50)} <b>{' '.join(w[1][:50]).upper()}</b>,\n\n{filler(30)}", 3: f"{filler(20)} {'. '.join(changed)} {filler(20)}",
        4: f"{filler(30)} {' '.join(w[3][20:45])} {filler(30)}", 5: f"{stock} {filler(90)}", 6: None, 7: "", 8: f"{filler(30000)} {passages[4]} {passages[5]}", 9: " ".join(reversed(w[0])), 10: "a",
    }
    d = spark.createDataFrame([(i, t, "x") for i, t in docs.items()] + [(1, docs[1], "x")], "doc_id long, text string, item_id string")
    e = spark.createDataFrame([(100 + i, p) for i, p in enumerate(passages)] + [(200, None), (201, " ")], "item_id long, passage string")
    got = rows(leakage.leaks(d, e).select("doc_id", "item_id"))
    assert got == [(1, 100), (2, 101), (3, 102), (8, 104), (8, 105)]
    assert leakage.leaks(d, e.limit(0)).count() == 0 and leakage.leaks(d.limit(0), e).count() == 0


def test_leaks_in_several_passes(spark, monkeypatch):
    monkeypatch.setattr(leakage, "PASS_CHARS", 300)
    rng = random.Random(2)
    passages = [" ".join(rng.choice(WORDS) for _ in range(40)) for _ in range(4)]
    d = spark.createDataFrame([(i, p) for i, p in enumerate(passages)], "doc_id long, text string")
    e = spark.createDataFrame([(i, p) for i, p in enumerate(passages)], "item_id long, passage string")
    assert rows(leakage.leaks(d, e).select("doc_id", "item_id")) == [(i, i) for i in range(4)]


def test_alignment_counts_words_in_order():
    p = list("abcdefghij")
    assert leakage.aligned(p, list("xxabcdefghijyy")) == 10
    assert leakage.aligned(p, list("abcXefgYhij")) == 9
    assert leakage.aligned(p, list("jihgfedcba")) == 1


def test_banded_alignment_equals_the_whole_one():
    rng = random.Random(7)
    for _ in range(60):
        p = [rng.choice(WORDS) for _ in range(rng.randrange(1, 70))]
        copy = [w if rng.random() > 0.15 else rng.choice(WORDS) for w in p if rng.random() > 0.05]
        before = [rng.choice(WORDS) for _ in range(rng.randrange(0, 40))]
        text = before + copy + [rng.choice(WORDS) for _ in range(rng.randrange(0, 40))]
        assert abs(leakage.aligned(p, text, len(before), 20) - leakage.aligned(p, text)) <= 0
    assert leakage.aligned(list("abc"), [], 5, 2) == 0 and leakage.aligned(list("abc"), list("abc"), -50, 3) == 0


vocabulary = pytest.mark.skipif(not os.path.exists(packing.VOCABULARY), reason="no vocabulary file")


@vocabulary
def test_packing_keeps_every_token_and_every_limit(spark):
    rng = random.Random(3)
    texts = [(i, "Prompt line\n" + " ".join(rng.choice(WORDS) for _ in range(rng.randrange(1, 120)))) for i in range(300)]
    texts += [(1000, None), (1001, ""), (1002, " "), (1003, " ".join(rng.choice(WORDS) for _ in range(3000))), (1004, "no end of line"), (5, texts[5][1])]
    limits = packing.Limits(tokens=256, segments=5, loss=230)
    docs = spark.createDataFrame([(*t, 0) for t in texts], "doc_id long, text string, tokens int")
    packed = packing.pack(docs, limits, shard_rows=120).collect()
    sizes, over = {}, set()
    for r in packing.count_tokens(docs).collect():
        sizes.setdefault(r["doc_id"], []).append(r["tokens"])
        if r["tokens"] > limits.tokens or r["loss"] > limits.loss:
            over.add(r["doc_id"])
    load = {}
    for r in packed:
        if r["container_id"] is not None:
            c = load.setdefault(r["container_id"], [0, 0, 0])
            c[0] += r["tokens"]
            c[1] += 1
            c[2] += r["loss_tokens"]
            assert r["tokens"] <= sizes[r["doc_id"]][0]
    assert all(t <= 256 and s <= 5 and m <= 230 for t, s, m in load.values())
    assert sum(r["tokens"] for r in packed) == sum(sum(v) for v in sizes.values())
    split = {r["doc_id"] for r in packed if r["piece"] > 0}
    assert split == over and 1003 in split
    assert {r["doc_id"] for r in packed if r["container_id"] is None} == {1000, 1001}
    assert {r["doc_id"] for r in packed} == {t[0] for t in texts}
    assert sum(t for t, _, _ in load.values()) / (256 * len(load)) > 0.85
    assert packing.pack(docs.limit(0), limits).count() == 0


def test_a_text_that_fits_a_container_is_whole(spark):
    sizes = spark.createDataFrame([(1, 4001, 3980), (2, 4096, 4096), (3, 4097, 4090)], "doc_id long, tokens int, loss int")
    got = sorted(tuple(r) for r in packing.split_large(sizes, packing.Limits()).select("doc_id", "piece", "tokens").collect())
    assert got == [(1, 0, 4001), (2, 0, 4096), (3, 0, 4096), (3, 1, 1)]


@vocabulary
def test_token_counts_match_the_whole_text(spark):
    import base64

    import tiktoken

    with open(packing.VOCABULARY, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    encode = tiktoken.Encoding("t", pat_str=packing.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    texts = ["One line. Two\nthree <|endoftext|> ünï", "it's 42", "a" * 3000, "\n\nx"]
    got = {r["doc_id"]: r["tokens"] for r in packing.count_tokens(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert all(abs(got[i] - len(encode(t))) <= 1 for i, t in enumerate(texts))


def test_certain_shapes():
    text = (
        "Write to a.b+c@mail.x-y.example, x_y [at] example dot org or call +44 (0)7700 900 530, (415) 555-0136, 0049-30-23125-186, 01.99.00.33.84, 12025550195. ID QQ 94 86 99 C, X7186285Z, 925-94-3582, 25.37.71-067.56, 700653-936X. "
        "Not: file.mp3@336, @handle_dj, checksum 2639032410820, serial SN 28-728-510, WAX-925-8733, 2021-02-23 6:49, ISRC QZ-KLM-23-99751, Ticket 65992908."
    )
    got = {(text[a:b], k) for a, b, k in privacy.certain(text)}
    want = {(x, "email") for x in ("a.b+c@mail.x-y.example", "x_y [at] example dot org")}
    want |= {(x, "phone") for x in ("+44 (0)7700 900 530", "(415) 555-0136", "0049-30-23125-186", "01.99.00.33.84", "12025550195")}
    want |= {(x, "id_number") for x in ("QQ 94 86 99 C", "X7186285Z", "925-94-3582", "25.37.71-067.56", "700653-936X")}
    assert got == want


def test_certain_shapes_of_any_country():
    text = "Call +39 02 1234 5678 or 0081 3 1234 5678, mail name at host dot it or x [at] y dot co dot nz or z at w dot co.uk. Dancing at club.The end."
    got = {(text[a:b], k) for a, b, k in privacy.certain(text)}
    assert got == {("+39 02 1234 5678", "phone"), ("0081 3 1234 5678", "phone"), ("name at host dot it", "email"), ("x [at] y dot co dot nz", "email"), ("z at w dot co.uk", "email")}


def test_personal_details_by_disclosure(spark):
    people = ["Nula Visakap", "Fulo Zorsodob", "Morene R. Tennep", "Zofo Gunbap", "Dada Nebont", "Kosie Rodad"]
    docs, n = [], 0
    for i, p in enumerate(people * 3):
        docs.append((n := n + 1, f"The set was long. Account holder: {p}; mail: user{i}@mail.example; that is all."))
    for i in range(60):
        docs.append((n := n + 1, f"Lunar Garden sits between house and dub. {i} Lunar Street is the opener of Garden Tapes, not a shop. Keiko Performer closed the night with Garden Lunar."))
    docs += [(905, "Mrs Visakap, Nula has left.\nDrop it through the door of 7 Harbour Lane after six.")]
    docs += [(900, "Mrs Fulo Zorsodob at the front desk has the stick.\nParcels go to 12 Harbour Lane, 30552 Town."), (901, None), (902, ""), (903, "x" * 20000), (904, "Ask 5@6 nothing")]
    d = spark.createDataFrame([(*x, "clash") for x in docs], "doc_id long, text string, cue string")
    a = spark.createDataFrame([("Keiko Performer",), (None,)], "artist_name string")
    got = rows(privacy.personal_details(d, a))
    assert {(k, t) for _, k, t in got if k == "person_name"} == {("person_name", p) for p in [*people, "Visakap, Nula"]}
    assert {(905, "street_address", "7 Harbour Lane"), (900, "street_address", "12 Harbour Lane")} <= set(got)
    assert (900, "person_name", "Fulo Zorsodob") in got
    assert sum(k == "email" for _, k, _ in got) == 18
    assert not any(k == "street_address" and "Lunar" in t for _, k, t in got)
    clean = {r["doc_id"]: r["text"] for r in privacy.sanitised(d, a).collect()}
    assert clean[1] == "The set was long. Account holder: [PERSON_NAME]; mail: [EMAIL]; that is all." and clean[901] is None and len(clean) == len(docs)
    assert privacy.personal_details(d.limit(0), a).count() == 0


def test_bare_numbers_are_judged_by_what_leads_to_them(spark):
    """The same ten digits are a telephone behind a word that leads to formatted numbers, and an order's behind one that does not."""
    docs = [f"Call ({200 + i}) 555-01{i:02d} before noon." for i in range(20)] + [f"Pack order {2124480000 + i} first." for i in range(20)]
    docs += ["Please call 2124481234 today.", "Look at order 2124489876 again.", "Mail anna at posteo dot ch, or 7182345678.", "anna at posteo [dot] at"]
    d = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    got = {(k, t) for i, k, t in rows(privacy.personal_details(d, spark.createDataFrame([], "artist_name string"))) if i >= 40}
    assert got == {("phone", "2124481234"), ("email", "anna at posteo dot ch"), ("phone", "7182345678"), ("email", "anna at posteo [dot] at")}


def test_placeholders_stand_at_the_place_of_the_piece(spark):
    text = "Mail ann@x.example today. The joann@x.example.org list and xann@x.examples are others; ann@x.example, again."
    d = spark.createDataFrame([(1, text), (1, "nothing"), (2, None)], "doc_id long, text string")
    got = rows(privacy.sanitised(d, spark.createDataFrame([], "artist_name string")))
    assert got == [(1, "Mail [EMAIL] today. The [EMAIL] list and [EMAIL] are others; [EMAIL], again."), (1, "nothing"), (2, None)]
