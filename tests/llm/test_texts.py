"""Problems 2, 5, 6, 7 and 8: rules on small cases, exact round trips, held-out accuracy."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from framelake.llm import garbled, packing, replies, splits, tokens
from framelake.llm.names import clip_and_second

# -- problem 2 --------------------------------------------------------------------------------
PROMPTS = [("prompt1", "Say where and what.\nsetting: [kind of place]\nactivity: [what goes on there]", "en"), ("caption_description", "Write one lively sentence about the people and the place.", "en")]


@pytest.mark.parametrize("t", [None, "", " \n", "​", "...", "[]", "N/A", "n/a.", "setting:\nactivity: -", "- setting: []\n- activity: none"])
def test_empty(t):
    assert replies.is_empty(t)


@pytest.mark.parametrize("t", ["setting: nana's house", "noon", "setting: patio\nactivity: "])
def test_not_empty(t):
    assert not replies.is_empty(t)


@pytest.mark.parametrize("t", ["I'm sorry, but I cannot comment on this.", "This request cannot be fulfilled.", "setting: we regret that we can’t say\nactivity: it is not possible for me", "As a language model, I pass", "setting: unable to assist\nactivity: unable to assist", "setting: cannot say\nactivity: unable to describe people", "setting: [declined]\nactivity: [withheld]"])
def test_refusal(t):
    assert replies.is_refusal(t)


@pytest.mark.parametrize("t", ["They can't stop giggling.", "A sticker says “I can't see, sorry”.", "She seems unable to resist.", "setting: patio\nactivity: cannot reach the shelf", "setting: attic\nactivity: [unable to resist the icing]", "I'm told the photo was taken without permission of the cat."])
def test_no_refusal(t):
    assert not replies.is_refusal(t)


def test_echo():
    e = replies.Echo([p[1] for p in PROMPTS])
    assert e("write one LIVELY sentnece about the people") and e("setting: [kind of place]") and not e("setting: [swimming pool]\nactivity: baking") and not e("setting: \nactivity:")


def test_unwrap_and_quotes():
    assert replies.unwrap("“A “big” cake.”") == "A “big” cake." and replies.unwrap('"a" and "b"') == '"a" and "b"'
    assert replies.open_quotation("says “hel") and not replies.open_quotation("„Gute Nacht“ and “x”")


def test_defects(spark, data):
    docs = spark.read.parquet(f"{data.replace('0.001', '0.01')}/documents.parquet")
    whole = [f"A {who} is {what} in the {where}." for who in ("girl", "boy", "baker") for what in ("eating noodles", "painting a fence", "feeding ducks") for where in ("village square", "kitchen", "harbour")]
    rows = [("results", i, "caption_description", t) for i, t in enumerate(whole * 3)]
    odd = {500: (None, "empty"), 501: ("A girl is painting a", "truncated"), 502: ("A boy is feeding ducks in the harbour", None), 503: ("Ein Junge füttert die Enten neben der Tür im Garten.", "language"), 504: ("I must decline to say.", "refusal"), 505: (PROMPTS[1][1].upper(), "echo"), 506: ("A boy is feeding duc-", "truncated"), 507: ("A boy is eating “nood", "truncated"), 508: ("“A girl is eating noodles in the kitchen”", None), 509: ("A girl" + " is eating noodles in the kitchen and" * 3000 + " a", "truncated")}
    rows += [("results", i, "caption_description", t) for i, (t, _) in odd.items()]
    rows += [("raw_outputs_a", i, "prompt1", f"setting: {p}\nactivity: {a}") for i, (p, a) in enumerate([("kitchen", "eating noodles"), ("harbour", "feeding ducks")] * 30)]
    rows += [("raw_outputs_a", i, "prompt1", f"activity: {a}\nsetting: {p}") for i, (p, a) in enumerate([("kitchen", "eating noodles"), ("harbour", "feeding ducks")] * 30, 100)]
    rows += [("raw_outputs_a", 900, "prompt1", "setting: kitchen\nactiv"), ("raw_outputs_a", 901, "prompt1", "setting: kitchen\nactivity: eating noo"), ("raw_outputs_a", 902, "prompt1", "Sure!\nsetting: [harbour]\nactivity: [feeding ducks]"), ("raw_outputs_a", 903, "prompt1", "lugar: junto al árbol\nactividad: mira el océano en la plaza")]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "table_name string, rec_id long, field string, text string, k1 string, defect int")
    pr = spark.createDataFrame(PROMPTS, "field_name string, prompt_text string, expected_lang string")
    got = {(r.table_name, r.rec_id): r.defect for r in replies.defects(df, pr, docs).collect()}
    want = {("results", i): d for i, (_, d) in odd.items() if d} | {("raw_outputs_a", 900): "truncated", ("raw_outputs_a", 901): "truncated", ("raw_outputs_a", 903): "language"}
    assert got == want
    assert replies.defects(df.limit(0), pr, docs).count() == 0
    assert replies.defects(df.limit(3), pr.limit(0), docs.limit(0)).count() >= 0


def test_languages_held_out(spark, data):
    docs = spark.read.parquet(f"{data.replace('0.001', '0.01')}/documents.parquet").filter("length(text) between 60 and 2000")
    fit, held = docs.filter("doc_id % 2 = 0"), docs.filter("doc_id % 2 = 1 and lang in ('en', 'de', 'fr', 'es', 'pt', 'pl', 'ru', 'ja')").select("lang", "text").toPandas()
    m = replies.fit_languages(fit)
    best = [replies.LANGUAGES[i] for i in m.posteriors(held["text"].to_list()).argmax(axis=1)]
    assert sum(a == b for a, b in zip(best, held["lang"])) >= 0.85 * len(held)


# -- problem 5 --------------------------------------------------------------------------------
@pytest.mark.parametrize("p,want", [("/l/f/6409771c5e4e_a b_1_26.697.jpg", ("a_b_1", 26697000)), ("\\l\\f\\6409771c5e4e_A%20b_1_26,697_copy.JPEG", ("a_b_1", 26697000)), ("./o/A_B_1__t000026.697__6409771c5e4e.png", ("a_b_1", 26697000)), ("/l/6409771c5e4e_A B_1_26.70 (3).jpg", ("a_b_1", 26700000)), ("/l/nothing.jpg", None), (None, None), ("", None)])
def test_names(p, want):
    assert clip_and_second(p) == want


def test_overlaps(spark):
    rng = random.Random(1)
    rows = [(i, f"/x/{rng.getrandbits(48):012x}_{rng.choice(['hot clip', 'HOT_CLIP', 'b-2', 'c_3'])}_{rng.randrange(0, 40) / 8:.3f}.jpg", rng.choice([True, False, None]), rng.choice("AB")) for i in range(300)]
    rows += [(900, None, True, "A"), (901, "/x/odd.jpg", False, "A"), (902, rows[0][1], True, "A"), (903, rows[0][1], False, None)]
    want = set()
    for i, p, v, _ in rows:
        for j, q, w, _ in rows:
            a, b = clip_and_second(p), clip_and_second(q)
            if v and not w and a and b and a[0] == b[0] and abs(a[1] - b[1]) <= 250_000:
                want.add((min(i, j), max(i, j)))
    df = spark.createDataFrame([(*r, "clash", 0) for r in rows], "label_id long, face_crop_path string, is_val boolean, corpus string, code string, cell int")
    got = [(r.label_id_1, r.label_id_2) for r in splits.overlap_pairs(df).collect()]
    assert set(got) == want and len(got) == len(want)
    rep = splits.overlap_report(df)
    assert {r[0] for r in rep.groupBy("split").agg(F.sum("exact_pairs")).select("sum(exact_pairs)").collect()} == {len(want)}
    assert rep.filter("split = 'evaluation'").agg(F.sum("exact_rows")).first()[0] == len({p for p in {a for a, _ in want} | {b for _, b in want} if (rows[p][2] if p < 900 else p == 902)})
    assert splits.overlap_pairs(df.limit(0)).count() == 0


def test_altered_stems_are_near_twins(spark):
    stem = "christmas_morning_at_the_old_farmhouse_{}_kitchen_window_of_grandmother"
    rows = [(1, f"/x/0123456789ab_{stem.format('tape')}_7.5.jpg", True, "A"), (2, f"/x/0123456789ab_{stem.format('type')}_7.6.jpg", False, "B"), (3, f"/x/0123456789ab_{stem.format('tape')}_7.4.jpg", None, "C"), (4, f"/x/0123456789ab_{stem.format('type')}_9.jpg", False, "B"), (5, "/x/0123456789ab_an_altogether_different_clip_7.5.jpg", False, "B")]
    df = spark.createDataFrame(rows, "label_id long, face_crop_path string, is_val boolean, corpus string")
    got = {(r.val_id, r.train_id, r.exact) for r in splits.overlaps(df, radius=15, similarity=0.8).collect()}
    assert got == {(1, 2, False), (1, 3, True)}
    rep = {(r.split, r.corpus): (r.exact_rows, r.near_rows, r.exact_pairs, r.near_pairs) for r in splits.overlap_report(df, radius=15).collect()}
    assert rep == {("evaluation", "A"): (1, 1, 1, 1), ("training", "B"): (0, 1, 0, 1), ("training", "C"): (1, 0, 1, 0)}
    assert splits.overlaps(df).count() == 1 and splits.overlap_report(df.limit(0)).count() == 0


# -- problem 6 --------------------------------------------------------------------------------
def test_tree_is_exact():
    enc, _ = tokens.encoder(tokens.default_vocabulary())
    rng = random.Random(2)
    for alphabet in ("a", "ab", "aeinrst", "éñü", "漢字カナ", "=-", "0123456789", "etaoin "):
        for _ in range(12):
            data = "".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 1500))).encode()
            for leaf in (5, 64):
                assert tokens.encode_tree(enc, data, leaf) == enc._encode_single_piece(data)


def test_encode(spark):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    rng = random.Random(3)
    texts = [None, "", " ", "\n\n  \t", "plain words here", "<|endoftext|> x", "naïve – 漢字 👩‍👧", "z" * 9000, "word " * 4000, "x" + "é" * 6000 + " tail  end", "".join(rng.choice("ab \n") for _ in range(20000)), "z" * 9000, "  " * 3000 + "q"]
    df = spark.createDataFrame([(i if i != 11 else 7, t, "clash", 0) for i, t in enumerate(texts)], "doc_id long, text string, part string, row int").repartition(3)
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    got = Counter((r.doc_id, tuple(r.ids)) for r in tokens.encode(df, leaf=512).collect())
    want = Counter((i if i != 11 else 7, tuple(t.encode(x or "", add_special_tokens=False).ids)) for i, x in enumerate(texts))
    assert got == want
    assert tokens.encode(df.limit(0)).count() == 0


# -- problem 7 --------------------------------------------------------------------------------
@pytest.mark.parametrize("forbid", [False, True])
def test_best_fit(forbid):
    rng = random.Random(4)
    sizes = [rng.randrange(1, 101) for _ in range(400)]
    cl = [rng.choice([-1, 1, 2, 3, 3, 3]) if rng.random() < 0.3 else -1 for _ in sizes]
    where, clash, fill, seen = packing.best_fit(sizes, cl, [1 << rng.randrange(3) for _ in sizes], 100, forbid)
    assert sum(fill) == sum(sizes) and max(fill) <= 100 and all(seen)
    got = Counter()
    for b, n in zip(where, sizes):
        got[b] += n
    assert [got[b] for b in range(len(fill))] == fill
    pairs = [(b, c) for b, c in zip(where, cl) if c >= 0]
    if forbid:
        assert len(pairs) == len(set(pairs)) and not any(clash)
    else:
        assert sum(clash) == len(pairs) - len(set(pairs))
        assert len(fill) <= -(-sum(sizes) // 100) * 1.03 + 1
        loose = packing.best_fit(sizes, [-1] * len(sizes), [1] * len(sizes), 100)
        assert len(fill) <= len(loose[2]) + 1


def test_best_fit_takes_the_tightest():
    where, _, fill, _ = packing.best_fit([60, 55, 40, 45], [-1] * 4, [1] * 4, 100)
    assert fill == [100, 100] and where == [0, 1, 0, 1]
    # two copies part where another container has room
    where, _, _, _ = packing.best_fit([50, 50, 10, 10], [-1, -1, 7, 7], [1] * 4, 60)
    assert where[2] != where[3]
    # of equally tight containers, the one without the source
    where, _, _, seen = packing.best_fit([50, 50, 10], [-1] * 3, [1, 2, 2], 60)
    assert where[2] == 0 and seen == [3, 2]


def test_best_fit_parts_copies_of_unequal_length():
    # 34 meets only its copy; 5 then fits beside the copies (6 left), and where there is none (8 left)
    where, _, fill, _ = packing.best_fit([92, 60, 34, 5], [-1, 7, 7, 7], [1] * 4, 100)
    assert where == [0, 1, 1, 0] and fill == [97, 94]


def test_pack(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice([0, 3, 30, 256, 257, 5000, None]), rng.choice(["a", "b", None]), rng.choice([None, 1, 2])) for i in range(300)]
    rows += [(5, 30, "a", 1)] * 4
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, n_tokens int, source string, cluster long, window_name string, shard int")
    win = spark.createDataFrame([("short", 256), ("long", 4096), ("none", 0), ("null", None)], "window_name string, capacity_tokens int")
    got = packing.pack(df, win, shard_items=100).toPandas()
    for name, cap in (("short", 256), ("long", 4096)):
        g = got[got.window_name == name]
        assert g.groupby("container_id").n_tokens.sum().max() <= cap
        assert (g.groupby("doc_id").n_tokens.sum() == pd_sum(rows)).all()
        whole = g[g.container_id.notna()]
        assert (whole[whole.start_token > 0].n_tokens <= cap).all()
        cut = {r[0] for r in rows if (r[1] or 0) > cap}
        assert set(g[g.part_no > 0].doc_id) <= cut
    assert set(got.window_name) == {"short", "long"}
    again = packing.pack(df.repartition(7, "source"), win, shard_items=100).toPandas()
    key = ["window_name", "doc_id", "part_no", "n_tokens", "container_id"]
    assert sorted(map(tuple, got[key].fillna("").to_numpy())) == sorted(map(tuple, again[key].fillna("").to_numpy()))
    with pytest.raises(ValueError):
        packing.pack(df, spark.range(1, 1100).selectExpr("'w' || id as window_name", "int(id) as capacity_tokens"))
    assert packing.pack(df.limit(0), win).count() == 0 and packing.pack(df, win.limit(0)).count() == 0


def pd_sum(rows):
    import pandas as pd

    return pd.DataFrame(rows, columns=["doc_id", "n", "s", "c"]).fillna({"n": 0}).groupby("doc_id").n.sum()


def test_containers_fill(spark, data):
    docs, win = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("documents", "context_windows"))
    got = {r.window_name: r.fill for r in packing.fill_report(packing.containers(docs, win)).collect()}
    assert got["short"] > 0.97 and len(got) == 3


def test_texts_of_one_id_are_packed_once_each(spark):
    docs = spark.createDataFrame([(1, "a short text", "a"), (1, "another one, a little longer", "b"), (1, "a short text", "a"), (2, None, None)], "doc_id long, text string, source string")
    win = spark.createDataFrame([("w", 64)], "window_name string, capacity_tokens int")
    got = packing.containers(docs, win).toPandas()
    assert len(got) == 4 and sorted(got.n_tokens) == [0, 3, 3, 6] and got.conflict.sum() == 1
    assert packing.fill_report(packing.containers(docs, win)).first().conflicts == 1
    r = packing.fill_report(packing.containers(docs, win, conflicts="forbid")).first()
    assert (r["containers"], r["conflicts"]) == (2, 0)


# -- problem 8 --------------------------------------------------------------------------------
CLEAN = ["Le garçon dévore une crêpe près de la fenêtre.", "El niño mira el océano en la estación.", "Die Großmutter pflückt reife Äpfel über dem Weg.", "Бабушка кормит уток на пляже после обеда.", "The café’s sign – “naïve” – cost £5 ± ½.", "弟が公園で凧を揚げている。", "UNA NIÑA SOÑOLIENTA MIRA EL OCÉANO."]


def damaged(t, wrong, right="utf-8"):
    return t.encode(right).decode(wrong, errors="strict" if wrong != "cp1252" else "replace")


def test_segments():
    import numpy as np

    assert garbled.segments(np.array([-1.0, 4, -1, 2, -9, 1, -2, 3])) == [(1, 3), (5, 5), (7, 7)]
    assert garbled.segments(np.array([-1.0, -2])) == [] and garbled.segments(np.zeros(0)) == []


def test_garbled(spark):
    rows = [(i, CLEAN[i % len(CLEAN)]) for i in range(700)]
    bad = {1000: (damaged(CLEAN[0], "latin-1"), CLEAN[0]), 1001: (damaged(CLEAN[1], "cp437"), CLEAN[1]), 1002: (damaged(CLEAN[2], "mac_roman"), CLEAN[2]), 1003: (damaged(CLEAN[3], "latin-1", "cp1251"), CLEAN[3]), 1004: (damaged(damaged(CLEAN[1], "latin-1"), "latin-1"), CLEAN[1]), 1005: (CLEAN[0] + " " + damaged(CLEAN[1], "cp1250"), CLEAN[0] + " " + CLEAN[1]), 1006: ("El ni�o mira", "El ni�o mira"), 1007: (damaged(CLEAN[3], "koi8_r", "cp1251"), CLEAN[3]), 1008: ("plain words " * 4000 + damaged(CLEAN[0], "latin-1"), "plain words " * 4000 + CLEAN[0])}
    fine = [(2000, None), (2001, ""), (2002, " \n"), (2003, "only ASCII"), (2004, CLEAN[1].upper()), (2005, CLEAN[4])]
    df = spark.createDataFrame([(*r, "clash", 0) for r in [*rows, *((i, b) for i, (b, _) in bad.items()), *fine]], "doc_id long, text string, restored string, pair int").repartition(4)
    got = {r.doc_id: r.restored for r in garbled.find_garbled(df).collect()}
    assert got == {i: w for i, (_, w) in bad.items()}
    assert garbled.find_garbled(df.limit(0)).count() == 0
    assert garbled.find_garbled(df.filter("doc_id between 2000 and 2003")).count() == 0


def test_pairs_count_every_document(spark):
    df = spark.createDataFrame([("aé",), ("aé",), (None,), ("",)], "text string")
    assert {r.pair: r.n for r in garbled.pair_counts(df).collect()}[(ord("a") << 21) | ord("é")] == 2


def test_garbled_in_a_corpus_repeated_ten_times(spark):
    japanese = ["おばあさんが庭で手を振っている。", "弟が駅のホームで絵本を読んで笑っている。"]
    bad = {1000: (japanese[0].encode("shift_jis").decode("latin-1"), japanese[0]), 1001: (japanese[1].encode("shift_jis").decode("latin-1"), japanese[1]), 1002: (damaged(CLEAN[3], "latin-1", "cp1251"), CLEAN[3]), 1003: (damaged(CLEAN[0], "latin-1"), CLEAN[0]), 1004: (damaged(CLEAN[3], "koi8_r", "cp1251"), CLEAN[3])}
    clean = [*CLEAN, *japanese]
    df = spark.createDataFrame([*((i, clean[i % len(clean)]) for i in range(900)), *((i, b) for i, (b, _) in bad.items())], "doc_id long, text string")
    want = {i: w for i, (_, w) in bad.items()}
    pairs = garbled.pair_counts(df).agg(F.sum("n")).first()[0]
    for k in (1, 10):
        many = df.crossJoin(spark.range(k).select(F.col("id").alias("copy"))).drop("copy")
        got = garbled.find_garbled(many, reference=pairs).collect()
        assert len(got) == k * len(want) and {r.doc_id: r.restored for r in got} == want
        if k == 10:  # western letters that are words of another script do not vouch for themselves
            free = {r.doc_id: r.restored for r in garbled.find_garbled(many).collect()}
            assert free.items() >= {i: w for i, w in want.items() if i != 1004}.items()


def test_misread_spans():
    jp = "絵本を読んで笑っている。".encode("shift_jis").decode("latin-1")
    assert garbled.misread_spans("ab " + jp + " c") == [(3, 3 + len(jp))]
    assert all(garbled.misread_spans(t) == [] for t in [*CLEAN, "préféré naïveté", "UN ÑANDÚ", "Æøå ÆØÅ"])


def test_share_of_damage_that_is_restored(spark, data):
    """Damage planted into passages of the tables' documents comes back as it was."""
    docs = spark.read.parquet(f"{data.replace('0.001', '0.01')}/documents.parquet").filter("text is not null").select("doc_id", "text").toPandas()
    bad = {r.doc_id for r in garbled.find_garbled(spark.createDataFrame(docs)).collect()}
    docs = docs[~docs.doc_id.isin(bad)].reset_index(drop=True)
    able = [k for k, t in enumerate(docs.text) if sum(c > "\x7f" for c in t[:60]) > 2 and damage(t)]
    truth = {docs.doc_id[k]: docs.text[k] for k in able[::12]}
    docs["text"] = [damage(t) if i in truth else t for i, t in zip(docs.doc_id, docs.text)]
    got = {r.doc_id: r.restored for r in garbled.find_garbled(spark.createDataFrame(docs)).collect()}
    assert len(truth) >= 15 and len(got.keys() & truth.keys()) >= 0.95 * len(truth)
    assert sum(got.get(i) == t for i, t in truth.items()) >= 0.9 * len(truth)


def damage(t):
    try:
        return t[:60].encode("utf-8").decode("cp1252") + t[60:]
    except UnicodeDecodeError:
        return None
