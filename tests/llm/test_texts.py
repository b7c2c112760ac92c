import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidewire.llm import gray_index, leaks, mixing, near_text, pieces, tokens

WORDS = "公司 业绩 增长 储能 订单 risk the margin 外协 比例 调整 12.5 万元 股东 审计 export yard permit 库存 周转".split()


def _text(r, n):
    return "".join(r.choice(WORDS) + r.choice(["", "", "，", "。", " ", "\n"]) for _ in range(n))


def _runs(doc, items, least):
    grams = {}
    for i, t in enumerate(items):
        for k in range(len(t) - least + 1):
            grams.setdefault(t[k : k + least], set()).add(i)
    return {i for k in range(len(doc) - least + 1) for i in grams.get(doc[k : k + least], ())}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("abc", min_size=0, max_size=30), max_size=5), st.text("abc", max_size=80), st.integers(4, 9), st.integers(0, 4))
def test_automaton_against_all_windows(items, doc, least, anchor):
    found = leaks.SuffixAutomaton(items, least, anchor).spans(doc)
    assert set(found) == _runs(doc, items, least)
    for i, spans in found.items():
        covered = set()
        for k in range(len(doc) - least + 1):
            if doc[k : k + least] in items[i]:
                covered |= set(range(k, k + least))
        assert {p for s, e in spans for p in range(s, e)} == covered


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab", min_size=0, max_size=20), max_size=4), st.text("ab", max_size=40), st.integers(3, 6), st.integers(0, 3))
def test_longest_runs_and_item_cover(items, doc, least, anchor):
    found = leaks.SuffixAutomaton(items, least, anchor).matches(doc)
    for i, (longest, spans) in found.items():
        runs = [items[i][a:b] for a in range(len(items[i])) for b in range(a + least, len(items[i]) + 1) if items[i][a:b] in doc]
        assert longest == max(map(len, runs))
        covered = {p for a in range(len(items[i]) - least + 1) if items[i][a : a + least] in doc for p in range(a, a + least)}
        assert leaks.item_cover(items[i], doc, spans, least) == len(covered)


def test_a_repeated_passage_is_as_long_as_it_is(spark):
    r = random.Random(12)
    item = "".join(chr(0x4E00 + r.randrange(3000)) for _ in range(688))
    docs = spark.createDataFrame([(1, item[:70] * 12)], "doc_id long, text string")
    got = leaks.find_leaks(docs, spark.createDataFrame([(5, item)], "item_id long, text string")).first()
    assert (got.longest, got.covered, got.doc_share) == (70, 840, 1.0) and got.item_share == pytest.approx(70 / 688)


def test_normalise_and_positions():
    text = "Ａb－１２, ｱ_Σ 第3章\r\nZ"
    assert leaks.normalise(text) == "ab12アσ第3章z"
    assert [text[i] for i in leaks.positions(text)] == list("Ａb１２ｱΣ第3章Z")
    assert leaks.normalise(None) == leaks.normalise(" ,_ ") == ""


def test_leaks_in_documents(spark, monkeypatch):
    r = random.Random(1)
    items = [(i, _text(r, 60)) for i in range(12)] + [(50, None), (None, "x" * 80), (51, "")]
    docs = []
    for i in range(40):
        own = _text(r, 50)
        k = r.randrange(12)
        part = items[k][1][: r.choice([30, 90, 400])]
        docs.append((i, own + part.upper().replace("，", " ; ") + own if i % 3 else own, "v"))
    docs += [(100, None, "v"), (101, "", "v"), docs[1]]
    d, e = spark.createDataFrame(docs, "doc_id long, text string, item_id string"), spark.createDataFrame(items, "item_id int, text string")
    clean = [leaks.normalise(t) for _, t in items]
    truth = {(k, items[i][0]) for k, t, _ in docs for i in _runs(leaks.normalise(t), clean, 60) if items[i][0] is not None}
    got = [(x.doc_id, x.item_id) for x in leaks.find_leaks(d, e).collect()]
    assert truth and set(got) == truth and len(got) == len(truth)
    one = sorted(map(tuple, leaks.find_leaks(d, e).collect()))
    monkeypatch.setattr(leaks, "LOT_DOCUMENTS", 3)
    assert sorted(map(tuple, leaks.find_leaks(d, e, block_chars=500).collect())) == one == sorted(map(tuple, leaks.find_leaks(d, e, anchor=20).collect()))
    blocks = sorted(map(tuple, leaks.remove_leaks(d, e, max_share=0.9, block_chars=500).collect()))
    assert blocks == sorted(map(tuple, leaks.remove_leaks(d, e, max_share=0.9).collect()))
    cleaned = {x.doc_id: x for x in leaks.remove_leaks(d, e, max_share=0.9).collect()}
    assert set(cleaned) == {k for k, _ in truth}
    for x in cleaned.values():
        assert x.clean_text is None or not _runs(leaks.normalise(x.clean_text), clean, 120)
    assert leaks.find_leaks(d, e.limit(0)).count() == 0 and leaks.find_leaks(d.limit(0), e).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(-1, 5), min_size=1, max_size=90), st.data())
def test_range_maximum(values, data):
    table = pieces.RangeMaximum(np.array(values) + 1, len(values))
    low = data.draw(st.integers(0, len(values) - 1))
    high = data.draw(st.integers(low, len(values) - 1))
    part = values[low : high + 1]
    assert table.query(low, high) == low + max(i for i, v in enumerate(part) if v == max(part))


@pytest.mark.parametrize("limit, overlap", [(40, 8), (64, 0), (512, 32)])
def test_pieces_hold_limit_and_overlap(limit, overlap):
    r = random.Random(limit)
    texts = [_text(r, n) for n in (1, 50, 400, 3000)] + ["储能外协比例" * 900, "a" * 5000, "\r\n\r\n".join(_text(r, 30) for _ in range(40)), "🙂" * 700, " \n" * 900, "x\n\n\n" * 500]
    for t in texts:
        found = pieces.cut(t, limit, overlap)
        assert found[0][0] == 0 and found[-1][1] == len(t)
        assert all(tokens.count(t[s:e]) <= limit for s, e, _, _ in found)
        for (s1, e1, _, _), (s2, _, _, _) in zip(found, found[1:]):
            assert s1 < s2 <= e1
            if overlap:
                assert overlap - 2 <= tokens.count(t[s2:e1]) + 2 and tokens.count(t[s2:e1]) <= overlap + 6
            else:
                assert s2 == e1 or t[s2:e1] != ""
        if len(found) == 1:
            assert tokens.count(t) <= limit


def test_cuts_prefer_strong_boundaries():
    t = "甲乙丙丁。" * 12 + "\n\n" + "甲乙丙丁，" * 40
    found = pieces.cut(t, 120, 4)
    assert found[0][1] == t.index("\n\n") + 2 and pieces.NAMES[found[0][3]] == "paragraph"


def test_split_of_dirty_documents(spark):
    rows = [(1, "短文。", 1), (2, None, 1), (3, "", 1), (4, "长文，" * 2000, 1), (4, "长文，" * 2000, 1), (None, "x", 1)]
    got = pieces.split_oversized(spark.createDataFrame(rows, "doc_id long, text string, piece_no int")).collect()
    assert sorted((r.doc_id or 0, r.piece_no) for r in got if r.doc_id != 4) == [(0, 1), (1, 1), (2, 1), (3, 1)]
    long = sorted([r for r in got if r.doc_id == 4], key=lambda r: r.piece_no)
    assert len(long) == 2 * long[0].pieces and all(r.n_tokens <= 512 and r.piece == ("长文，" * 2000)[r.start_char : r.end_char] for r in long)
    with pytest.raises(ValueError):
        pieces.split_oversized(spark.createDataFrame(rows, "doc_id long, text string, piece_no int"), overlap=256)


def test_splitting_tree_is_exact():
    quotas = [0, 1, 17, 1000, 3]
    deal = mixing.splitting_tree(quotas, 13, 5)
    assert deal.sum(axis=0).tolist() == quotas and deal.min() >= 0
    sizes = deal.sum(axis=1)
    assert sizes.max() - sizes.min() <= 5 and (mixing.splitting_tree(quotas, 13, 5) == deal).all()


def test_quotas():
    plan = mixing.plan_quotas({"a": (10, 1000), "b": (5, 100), "x": (3, 50)}, {"a": (0.5, 1), "b": (0.4, 3), "c": (0.1, 9)})
    assert plan["b"]["full"] == 3 and plan["b"]["rest"] == 0.0 and plan["a"]["full"] == 0 and plan["a"]["rest"] == pytest.approx(375)
    assert mixing.plan_quotas({}, {"a": (1.0, 1)}) == {}


def test_mix_reaches_targets(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_ROWS", 8)
    monkeypatch.setattr(mixing, "SHARD_ROWS", 40)
    r = random.Random(9)
    rows = [(i, r.choice(["big"] * 8 + ["mid"] * 3 + ["small", "extra", None]), _text(r, r.randrange(1, 30)), 0) for i in range(500)] + [(900, "mid", None, 0), (901, "mid", "", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, shard int")
    targets = spark.createDataFrame([("big", 0.5, 1), ("mid", 0.3, 2), ("small", 0.15, 4), ("gone", 0.05, 2)], "source string, target_share double, max_repeats int")
    counted = mixing.count_tokens(docs, "doc_id", "source", "text")
    mixed = mixing.mix_sources(docs, targets, counted=counted)
    got = mixed.collect()
    assert sorted((x.doc_id, x.copy_no) for x in got) == sorted(set((x.doc_id, x.copy_no) for x in got))
    assert {x.source for x in got} == {"big", "mid", "small"} and max(x.copy_no for x in got if x.source == "big") == 1
    shares = {x.source: x for x in mixing.reached_shares(mixed, targets, counted).collect()}
    for s, t in (("big", 0.5), ("mid", 0.3), ("small", 0.15)):
        assert shares[s].share == pytest.approx(t / 0.95, abs=0.01) and shares[s].most_used <= {"big": 1, "mid": 2, "small": 4}[s]
    assert shares["gone"].tokens == 0 and shares["extra"].tokens == 0 and shares[None].available_tokens > 0
    places = {}
    for x in got:
        places.setdefault(x.shard, []).append(x.place)
    assert len(places) >= 8 and all(sorted(p) == list(range(1, len(p) + 1)) for p in places.values())
    assert mixing.mix_sources(docs.limit(0), targets).count() == 0 and mixing.mix_sources(docs, targets.limit(0)).count() == 0
    some = mixing.mix_sources(docs, targets, total_tokens=1000, counted=counted).groupBy().sum("n_tokens").first()[0]
    assert 900 <= some <= 1000


@pytest.mark.parametrize("n, limit", [(0, 3), (1, 3), (300, 20), (400, 45)])
def test_gray_forest_against_all_pairs(n, limit):
    r = np.random.default_rng(n)
    key = r.integers(0, 4, n).astype(np.uint64)
    base = r.integers(0, 1 << 63, (5, 2)).astype(np.uint64)
    codes = base[r.integers(0, 5, n)] ^ (np.uint64(1) << r.integers(0, 64, (n, 2)).astype(np.uint64)) ^ (np.uint64(1) << r.integers(0, 64, (n, 2)).astype(np.uint64))
    order = gray_index.gray_order(key, codes[:, 0], codes[:, 1])
    key, codes = key[order], codes[order]
    a, b, bits = gray_index.GrayForest(key, codes[:, 0].copy(), codes[:, 1].copy()).self_pairs(limit)
    truth = set()
    for i in range(n):
        d = np.bitwise_count(codes[i] ^ codes[i + 1 :]).sum(axis=1)
        for j in np.flatnonzero((d <= limit) & (key[i + 1 :] == key[i])):
            truth.add((i, i + 1 + int(j), int(d[j])))
    assert {(int(x), int(y), int(z)) for x, y, z in zip(a, b, bits)} == truth


def test_gray_rank_counts_up():
    g = np.array([i ^ (i >> 1) for i in range(64)], np.uint64)
    _, low = gray_index.gray_rank(np.zeros(64, np.uint64), g)
    assert low.tolist() == list(range(64))
    high, low = gray_index.gray_rank(np.array([1], np.uint64), np.array([0], np.uint64))
    assert high[0] == 1 and low[0] == (1 << 64) - 1


def _edited(r, t):
    t = list(t)
    for _ in range(max(1, len(t) // 60)):
        k = r.randrange(len(t))
        t[k : k + 1] = r.choice([[], [t[k], t[k]], ["新"]])
    return "".join(t)


def _stories(r, n):
    out, truth = [], []
    for s in range(n):
        sentences = ["".join(chr(0x4E00 + r.randrange(900)) for _ in range(r.randrange(12, 30))) + "。" for _ in range(8)]
        first = len(out)
        for v in range(r.choice([1, 1, 2, 3])):
            mine = sentences[:]
            if v:
                i = r.randrange(7)
                mine[i], mine[i + 1] = mine[i + 1], mine[i]
            out.append((f"题{s}", _edited(r, "".join(mine)) if v else "".join(mine)))
        truth += [(i, j) for i in range(first, len(out)) for j in range(i + 1, len(out))]
    return out, truth


def test_near_duplicates(spark, monkeypatch):
    r = random.Random(11)
    stories, truth = _stories(r, 120)
    phrase = "".join(chr(0x5E00 + r.randrange(900)) for _ in range(60))  # a standing phrase in a third of all records
    rows = [(i, t, b + (phrase if i % 3 == 0 else ""), "v") for i, (t, b) in enumerate(stories)]
    n = len(rows)
    rows += [(n, rows[0][1], " ".join(rows[0][2]), "v"), (n + 1, rows[0][1], rows[0][2] + "！", "v"), (n + 2, None, None, "v"), (n + 3, "", "。", "v"), (None, "a", "b", "v"), (n + 4, "短讯", None, "v"), (n + 5, None, "短讯", "v")]
    pairs = {(i, j) for i, j in truth} | {(0, n), (0, n + 1), (n, n + 1), (n + 4, n + 5)} | {(j, k) for i, j in truth if i == 0 for k in (n, n + 1)}
    frame = spark.createDataFrame(rows, "record_no long, title string, body string, _key string").select("record_no", "title", "body", "_key")
    for group_rows in (near_text.GROUP_ROWS, 30):
        links, members = near_text.similar_pairs(frame, "record_no", ["title", "body"], similar=0.6, group_rows=group_rows)
        got = [(x.record_a, x.record_b) for x in near_text.all_pairs(links, members).collect()]
        assert len(got) == len(set(got)) and set(got) == pairs
    groups = {x._key: x.group_id for x in near_text.components(links, members).collect()}
    assert len(groups) == n + 4 and all(groups[i] == groups[j] for i, j in pairs) and len(set(groups.values())) == 121
    empty, nobody = near_text.similar_pairs(frame.limit(0), "record_no", ["title", "body"])
    assert near_text.all_pairs(empty, nobody).count() == 0 and near_text.components(empty, nobody).count() == 0


def _letters(r, n):
    return [chr(0x4E00 + r.randrange(3000)) for _ in range(n)]


def _changed(r, t, step):
    t = t[:]
    for i in range(r.randrange(step), len(t), step):
        t[i] = chr(0x4E00 + r.randrange(3000))
    return t


def _found(spark, texts):
    frame = spark.createDataFrame(list(enumerate(texts)), "record_no long, body string")
    links, members = near_text.similar_pairs(frame, "record_no", ["body"])
    return {(x.record_a, x.record_b) for x in near_text.all_pairs(links, members).collect()}


def _brute(texts):
    return {(i, j) for i in range(len(texts)) for j in range(i + 1, len(texts)) if near_text.shared_share(texts[i], texts[j]) >= near_text.SIMILAR}


def test_densely_edited_copies_are_found(spark):
    r = random.Random(3)
    texts = []
    for step, both in ((11, False), (13, False), (16, False), (22, True)):
        for _ in range(40):
            t = _letters(r, 300)
            texts += ["".join(_changed(r, t, step) if both else t), "".join(_changed(r, t, step))]
    truth = {(i, i + 1) for i in range(0, len(texts), 2) if near_text.shared_share(texts[i], texts[i + 1]) >= near_text.SIMILAR}
    got = _found(spark, texts)
    assert got <= truth and len(got) >= 0.98 * len(truth) > 140


@pytest.mark.parametrize("group_rows", [near_text.GROUP_ROWS, 40])
def test_large_group_with_a_standing_phrase_keeps_its_links(spark, group_rows):
    """Seventy versions of one story under a phrase that two hundred other texts end with too: parts that many hold are dropped only where the holders are unlike."""
    r = random.Random(6)
    story, phrase = _letters(r, 240), _letters(r, 60)
    texts = ["".join(_changed(r, story, 22) + phrase) for _ in range(70)] + ["".join(_letters(r, 240) + phrase) for _ in range(200)]
    frame = spark.createDataFrame(list(enumerate(texts)), "record_no long, body string")
    links, members = near_text.similar_pairs(frame, "record_no", ["body"], group_rows=group_rows)
    got = {(x.record_a, x.record_b) for x in near_text.all_pairs(links, members).collect()}
    truth = _brute(texts)
    assert got <= truth and len(got) >= 0.98 * len(truth) > 2300
    groups = {x._key: x.group_id for x in near_text.components(links, members).collect()}
    assert {groups[i] for i in range(70)} == {0} and all(groups[i] == i for i in range(70, 270))
    for stars in (5, near_text.STARS):
        assert {x._key: x.group_id for x in near_text.similar_groups(frame, "record_no", ["body"], group_rows=group_rows, stars=stars).collect()} == groups


@pytest.mark.parametrize("group_rows", [near_text.GROUP_ROWS, 40])
def test_texts_that_share_standing_phrases_only_are_found(spark, group_rows):
    """Six phrases that sixty unlike texts each end with; of four other texts they make up two thirds, in another order each, so that these share nothing else."""
    r = random.Random(9)
    phrases = ["".join(_letters(r, 60)) for _ in range(6)]
    texts = ["".join(_letters(r, 240)) + p for p in phrases for _ in range(60)]
    for order in ((0, 1, 2, 3, 4, 5), (5, 3, 1, 4, 2, 0), (2, 5, 0, 3, 1, 4), (4, 0, 5, 2, 1, 3)):
        texts.append("".join("".join(_letters(r, 25)) + phrases[i] for i in order))
    frame = spark.createDataFrame(list(enumerate(texts)), "record_no long, body string")
    links, members = near_text.similar_pairs(frame, "record_no", ["body"], group_rows=group_rows)
    got = sorted((x.record_a, x.record_b) for x in near_text.all_pairs(links, members).collect())
    assert got == sorted(_brute(texts)) and len(got) == 6
    groups = {x._key: x.group_id for x in near_text.similar_groups(frame, "record_no", ["body"], group_rows=group_rows, stars=5).collect()}
    assert all(groups[i] == min(i, 360) for i in range(364))


def test_similar_by_windows_finds_all_pairs(spark, monkeypatch):
    r = random.Random(10)
    texts = ["", "短", "短讯速", "短讯速" * 9, "𠀀𠀁𠀂𠀃𠀄𠀅", "𠀀𠀁𠀂𠀃𠀄𠀅" * 8]
    for step in (9, 10, 12, 15, 30) * 6:
        t = _letters(r, r.randrange(8, 160))
        half = len(t) // 2
        texts += ["".join(t), "".join(_changed(r, t, step)), "".join(t[half:] + t[:half] + _letters(r, r.randrange(half + 1))), "".join((t[:12] * 4)[: r.randrange(8, 48)])]
    texts = list(dict.fromkeys(texts))
    r.shuffle(texts)
    truth = {(i, j) for i, j in _brute(texts)} | {(i, j) for i in range(len(texts)) for j in range(i + 1, len(texts)) if near_text.shared_share(texts[j], texts[i]) >= near_text.SIMILAR}
    for chunk in (near_text.CHUNK, 40):  # few pairs at once, so that one text's come in turns
        monkeypatch.setattr(near_text, "CHUNK", chunk)
        for others in (0, 50):
            found = {tuple(sorted(x)) for x in near_text.similar_by_windows(texts, others)}
            assert found == {(i, j) for i, j in truth if not others or i < others <= j}
    monkeypatch.undo()
    clean = spark.createDataFrame(list(enumerate(texts)), "_key long, clean string")
    got = [tuple(x) for x in near_text.window_pairs(clean, lot=2000).collect()]  # several lots
    assert set(got) == truth and len(got) == len(truth) > 70


def test_gray_forest_leaves_pairs_of_one_label_out():
    r = np.random.default_rng(5)
    key, code, label = r.integers(0, 3, 300).astype(np.uint64), r.integers(0, 200, 300).astype(np.uint64), r.integers(0, 4, 300)
    order = gray_index.gray_order(key, code)
    key, code, label = key[order], code[order], label[order]
    every = {(int(a), int(b)) for a, b, _ in zip(*gray_index.GrayForest(key, code).self_pairs(2))}
    assert {(int(a), int(b)) for a, b, _ in zip(*gray_index.GrayForest(key, code, label=label).self_pairs(2))} == {(a, b) for a, b in every if label[a] == 0 or label[a] != label[b]}


def test_parts_of_a_passage_are_the_same_elsewhere():
    r = random.Random(7)
    shared = "".join(_letters(r, 200))
    texts = ["".join(_letters(r, 90)) + shared, shared + "".join(_letters(r, 90)), "a" * 900, "", "ab", shared]
    owner, head, code = near_text.Windows(texts).parts()
    one, other = ({(h, c) for o, h, c in zip(owner.tolist(), head.tolist(), code.tolist()) if o == k} for k in (0, 1))
    assert len(one & other) >= 10 and set(owner.tolist()) <= {0, 1, 2, 5} and (owner == 2).sum() == 1


def test_short_texts_are_found_as_by_brute_force(spark):
    r = random.Random(4)
    texts = ["哈哈哈哈哈哈", "哈", "哈哈", "短讯速", "短讯", "短讯速递今", "abcdefghij", "abcdefghi"]
    for n in range(9, 41):
        t = _letters(r, n)
        texts += ["".join(t), "".join(t[: n // 2] + _letters(r, 1) + t[n // 2 + 1 :]), "".join(t[n // 2 :] + t[: n // 2])]
        texts.append("".join(x for i in range(0, n, 9) for x in t[i : i + 8] + _letters(r, 1))[:40])
    texts = list(dict.fromkeys(texts))
    assert _found(spark, texts) == _brute(texts)


def test_long_chain_is_one_group(spark):
    ids = list(range(300))
    random.Random(8).shuffle(ids)
    links = spark.createDataFrame([(min(x), max(x)) for x in zip(ids, ids[1:])], "_a long, _b long")
    members = spark.createDataFrame([(i, i) for i in range(301)], "_key long, _first long")
    assert {(x._key, x.group_id) for x in near_text.components(links, members).collect()} == {(i, 0) for i in range(300)} | {(300, 300)}
    with pytest.raises(RuntimeError):
        near_text.components(links, members, rounds=1)


def test_shared_share():
    assert near_text.shared_share("abcdefghij", "abcdefghij") == 1.0 and near_text.shared_share("", "x") == 0.0
    assert near_text.shared_share("a" * 10 + "bcdefghijk", "bcdefghijk", 8) == pytest.approx(0.5)
