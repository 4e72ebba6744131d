"""Every operator on nulls, empty and long texts, ties, repeated rows, empty tables and extra columns."""

import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.llm.chat import Codec, escape, format_turns, loss_mask, read_back, render, unescape
from quern.llm.embedding_dedup import embedding_dedup
from quern.llm.exact_dedup import exact_dedup
from quern.llm.html_extract import Labeller, extract_main, made_pages, parse
from quern.llm.lm_score import score_documents
from quern.llm.mixing import mix_sources
from quern.llm.near_dedup import near_dedup
from quern.llm.packing import TextIds, pack_documents, tokenizer_path
from quern.llm.toxicity import score_toxicity

DOC = "doc_id long, text string, source string, _row string, id string, size string, node string, name string"
LONG = "word " * 30_000


def docs(spark, rows):
    """Documents with columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, s, "x", "x", "x", "x", "x") for i, t, s in rows], DOC)


ROWS = [(1, None, "a"), (2, "", "a"), (3, "x y z", None), (4, "x y z", "b"), (4, "x y z", "b"), (None, "x y z", "b"), (5, LONG, "b"), (6, LONG + "end", "c"), (7, "é ü\n\t ß", ""), (8, " \t\n", "c")]


def by_id(df, key="doc_id"):
    return sorted((r.asDict() for r in df.collect()), key=lambda r: (r[key] is None, r[key]))


def test_exact_dedup(spark):
    got = by_id(exact_dedup(docs(spark, ROWS)))
    assert len(got) == len(ROWS)
    texts = {i: t or "" for i, t, _ in ROWS}
    for r in got:
        assert r["text_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()
    groups = {}
    for r in got:
        groups.setdefault(r["text_sha256"], []).append(r)
    for same in groups.values():
        assert {r["group_size"] for r in same} == {len(same)} and sum(r["kept"] for r in same) == 1
        assert {r["keep_id"] for r in same} == {max((r["doc_id"] for r in same if r["doc_id"] is not None), default=None)}
    assert exact_dedup(docs(spark, [])).count() == 0


def test_exact_dedup_names_by_content_in_small_blocks(spark):
    rng = np.random.default_rng(1)
    rows = [(i, "".join(rng.choice(list("ab"), rng.integers(0, 40))), "s") for i in range(300)] + [(1000 + i, "ab" * 20, "s") for i in range(200)]
    got = {r["doc_id"]: r for r in by_id(exact_dedup(docs(spark, rows), block_bytes=4))}
    last, n = {}, {}
    for i, t, _ in rows:
        last[t], n[t] = max(last.get(t, i), i), n.get(t, 0) + 1
    assert all((got[i]["keep_id"], got[i]["group_size"], got[i]["kept"]) == (last[t], n[t], last[t] == i) for i, t, _ in rows)


def test_mixing(spark):
    got = by_id(mix_sources(docs(spark, ROWS)))
    assert len(got) == len(ROWS)
    sizes = {i: len((t or "").split()) for i, t, _ in ROWS}
    assert all(r["size"] == sizes[r["doc_id"]] and r["taken"] == r["copies"] * r["size"] and r["copies"] <= 3 for r in got)
    assert mix_sources(docs(spark, [])).count() == 0


def level(sizes, weights):
    """Targets by resharing what is cut off until no target is above three times its size."""
    targets, free = [0.0] * len(sizes), list(range(len(sizes)))
    left = float(sum(sizes))
    while free:
        w = sum(weights[i] for i in free)
        over = [i for i in free if left * weights[i] / w >= 3 * sizes[i]]
        if not over:
            for i in free:
                targets[i] = left * weights[i] / w
            break
        for i in over:
            targets[i] = 3.0 * sizes[i]
            left -= targets[i]
            free.remove(i)
    return targets


def test_mixing_meets_targets(spark):
    rng = np.random.default_rng(2)
    rows = [(i, "w " * int(rng.integers(1, 30)), f"s{int(rng.integers(0, 9) ** 2 // 10)}") for i in range(1500)] + [(9000 + i, "w w", None) for i in range(5)]
    once, again = by_id(mix_sources(docs(spark, rows))), by_id(mix_sources(docs(spark, rows).repartition(7)))
    assert once == again
    names = sorted({s for _, _, s in rows if s is not None}) + [None]
    size = [sum(len(t.split()) for _, t, x in rows if x == s) for s in names]
    want = dict(zip(names, level(size, [k % 3 + 1 for k in range(len(names))])))
    for s in names:
        own = [r for r in once if r["source"] == s]
        assert own[0]["target"] == pytest.approx(want[s]) and abs(sum(r["taken"] for r in own) - want[s]) <= 15
        assert len({r["copies"] for r in own if r["size"]}) <= 2


def test_chat(spark):
    tricky = "\\### Assistant: </turn> ok ### User: #### End: \\\\ </turn"
    rows = [
        (1, 0, "user", tricky), (1, 1, "assistant", tricky), (1, 1, "assistant", tricky), (1, None, None, None), (2, 0, "assistant", ""), (2, 1, "Robot: x", "a\n"), (2, 2, "assistant", LONG),
        (None, 0, "assistant", "é🙂"), (3, 0, "user", "no loss"),
    ]
    turns = spark.createDataFrame([(*r, "x", [1]) for r in rows], "conv_id long, turn long, role string, text string, ids string, mask array<int>")
    got = {r["conv_id"]: r for r in read_back(format_turns(turns)).collect()}
    assert set(got) == {1, 2, 3, None}
    for c, r in got.items():
        own = sorted(((-1 if t is None else t, o or "", x or "") for k, t, o, x in rows if k == c))
        loss = "".join(x for _, o, x in own if o == "assistant")
        assert r["n_turns"] == len(own) and r["loss_chars"] == len(loss) and r["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{o}\n{x}\n" for _, o, x in own).encode()).hexdigest()
    assert read_back(format_turns(turns.limit(0))).count() == 0
    codec = Codec(None)
    assert unescape(escape(tricky)) == tricky and "</turn>" not in escape(tricky) and "### User:" not in escape(tricky)
    ids = np.array(format_turns(turns.where("conv_id = 3")).first()["ids"])
    assert render(codec, ids) == "### User: no loss</turn>\n" and not loss_mask(ids).any()


def test_packing(spark):
    rows = [*ROWS, (20, "<|endoftext|> Don't, STOP... naïve.x\x1cy ΑΣ, é.", "a"), (21, "a" * 50_000, "b")]
    got = by_id(pack_documents(docs(spark, rows), keep_ids=True))
    tokenizer = TextIds(tokenizer_path(None)).tokenizer
    left = {}
    for i, t, _ in rows:
        left.setdefault(i, []).append([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0])
    for i, wanted in left.items():
        own = sorted((r for r in got if r["doc_id"] == i), key=lambda r: r["piece"])
        assert len(own) == sum(-(-len(w) // 2048) for w in wanted)
        for r in own:
            part = wanted[0][r["start"] : r["start"] + r["length"]]
            assert r["ids"] == part and r["ids_crc32"] == zlib.crc32(np.array(part, "<u4").tobytes()) and r["start"] == 2048 * r["piece"]
    fill = {}
    for r in sorted(got, key=lambda r: r["offset"]):
        assert fill.get(r["sequence_id"], 0) == r["offset"]
        fill[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(fill.values()) <= 2048
    assert pack_documents(docs(spark, [])).count() == 0


def test_toxicity(spark):
    rng = np.random.default_rng(4)
    plain, bad = [f"w{i}" for i in range(200)], ["vile", "rotten", "foul"]
    rows, labels = [], []
    for i in range(600):
        words = rng.choice(plain, rng.integers(5, 60)).tolist()
        toxic = i % 5 == 0
        if toxic:
            words[2:2] = rng.choice(bad, 3, replace=False).tolist()
        rows.append((i, " ".join(words), "s"))
        labels.append((i, int(toxic)))
    rows += [(9000, None, "s"), (9001, "", "s"), (9002, LONG, "s"), (None, "vile rotten", "s")]
    table = spark.createDataFrame([*labels, (5, None), (None, 1), (7, 0)], "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in score_toxicity(docs(spark, rows), table).collect()}
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got.values())
    held = [(r["predicted"], i % 5 == 0) for i, r in got.items() if i is not None and i < 600 and r["held_out"]]
    assert {i for i, r in got.items() if i is not None and r["held_out"]} == {i for i in got if i is not None and zlib.crc32(str(i).encode()) % 5 == 0}
    assert np.mean([p == t for p, t in held]) > 0.95
    assert got[9000]["score"] == got[9001]["score"] < 0.5
    one = score_toxicity(docs(spark, rows[:3]), table.where("toxic = 0")).collect()
    assert [r["score"] for r in one] == [0.0] * 3
    assert score_toxicity(docs(spark, []), table.limit(0)).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>if (a<b) "</p>"</script></head><body><nav><ul><li><a href=/>Home</a></li><li><a href=/b>About us</a></li></ul></nav>
<!-- no > comment --><div class="ad">Buy now, cheap.</div><article><h1>A &amp; B&nbsp;&lt;c&gt;</h1><p>First   line<br>goes <b>on</b> here, with more words to read.<p>Second &eacute; one &#x41; of the text, which is number QQ.</article>
<div class="comments"><p>Nice post, thanks a lot.</p></div><form>Name <input></form><footer>&copy; x</footer></body>"""


def test_pages(spark):
    texts = [b.text for b in parse(PAGE)]
    assert "A & B <c>" in texts and "First line goes on here, with more words to read." in texts and not any("p{}" in t or "if (a" in t or "no >" in t for t in texts)
    odd = [None, "", "<p", "<", "a < b", "<p>x", "</p></div>y", "<p title='>'>z</p>", "<script>never closed", "<div " * 50, "&amp", "<b><p>q</b></p>r", "<li>1<li>2"]
    assert [[b.text for b in parse(o or "")] for o in odd] == [[], [], [], ["<"], ["a < b"], ["x"], ["y"], ["z"], [], [], ["&"], ["q", "r"], ["1", "2"]]
    pages = spark.createDataFrame([(i, f"u{i}", PAGE.replace("QQ", str(i)), "t", 1) for i in range(60)] + [(100 + i, "u", p, "t", 1) for i, p in enumerate(odd)], "page_id long, url string, html string, text string, n_chars int")
    got = {r["page_id"]: r for r in extract_main(pages).collect()}
    assert len(got) == 60 + len(odd) and got[100]["text"] == got[101]["text"] == ""
    want = "A & B <c>\nFirst line goes on here, with more words to read.\nSecond é one A of the text, which is number {}."
    assert np.mean([got[i]["text"] == want.format(i) for i in range(60)]) > 0.9
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())
    assert extract_main(pages.limit(0)).count() == 0


def test_labeller_gradients():
    rng = np.random.default_rng(5)
    m = Labeller(width=5, hidden=3)
    m.w = {k: v.astype(np.float64) + 0.1 * rng.standard_normal(v.shape) for k, v in m.w.items()}
    x, mask = rng.standard_normal((4, 2, 5)), np.array([[1, 1], [1, 1], [1, 0], [1, 0]], bool)
    y = rng.integers(0, 2, (4, 2)).astype(float)
    _, grads = m.gradients(x, mask, y)
    for name in m.w:
        at = tuple(rng.integers(0, n) for n in m.w[name].shape)
        keep, d = m.w[name][at], 1e-4
        m.w[name][at] = keep + d
        up = m.gradients(x, mask, y)[0]
        m.w[name][at] = keep - d
        down = m.gradients(x, mask, y)[0]
        m.w[name][at] = keep
        assert grads[name][at] == pytest.approx((up - down) / (2 * d), abs=2e-3), name


def test_made_pages_have_both_labels():
    pages = made_pages(["A paragraph of some words.", "Another one, longer than that."], 30)
    assert {b.main for p in pages for b in p} == {0, 1} and all("" not in b.text and "" not in b.text for p in pages for b in p)


def kneser_ney(train, texts):
    """log10 probabilities by an interpolated modified Kneser-Ney model of word pairs, plainly."""
    from collections import Counter

    seq = lambda t: ["</s>", *t.lower().split(), "</s>"]
    uni, big = Counter(), Counter()
    for t in train:
        s = seq(t)
        uni.update(s[1:])
        big.update(zip(s, s[1:]))
    pred = Counter(w for _, w in big)

    def discounts(counts):
        n = [sum(c == k for c in counts.values()) for k in range(1, 5)]
        y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.5
        d = [1 - 2 * y * n[1] / n[0] if n[0] else 0.5, 2 - 3 * y * n[2] / n[1] if n[1] else 1.0, 3 - 4 * y * n[3] / n[2] if n[2] else 1.5]
        return [0, *(min(max(x, 0.05), k + 0.95) for k, x in enumerate(d))]

    dp, dw = discounts(big), discounts(pred)
    v, total = len(uni), sum(pred.values())
    rest = sum(dw[min(c, 3)] for c in pred.values()) / total
    out = []
    for t in texts:
        s, log, base = seq(t), 0.0, 0.0
        for a, b in zip(s, s[1:]):
            low = max(pred[b] - dw[min(pred[b], 3)], 0) / total + rest / (v + 1)
            after = [c for (x, _), c in big.items() if x == a]
            p = low
            if after:
                p = max(big[a, b] - dp[min(big[a, b], 3)], 0) / uni[a] + sum(dp[min(c, 3)] for c in after) / uni[a] * low
            log += np.log10(p)
            base += np.log10((uni[b] + 0.1) / (sum(uni.values()) + 0.1 * (v + 1)))
        out.append((log, base, sum(uni[w] > 0 for w in s[1:]), len(s) - 1))
    return out


def test_lm_scores_equal_a_plain_model(spark):
    rng = np.random.default_rng(6)
    words = [f"W{i}" for i in range(25)]
    rows = [(i, " ".join(words[int(k)] for k in rng.zipf(1.5, rng.integers(0, 30)) % 25), "s") for i in range(120)] + [(500, None, "s"), (501, "never seen", "s"), (None, "w1", "s")]
    got = by_id(score_documents(docs(spark, rows)))
    held = lambda i: zlib.crc32(("null" if i is None else str(i)).encode()) % 10 == 0
    train = [t or "" for i, t, _ in rows if not held(i)]
    wanted = dict(zip([i for i, _, _ in rows], kneser_ney(train, [t or "" for _, t, _ in rows])))
    for r in got:
        log, base, known, n = wanted[r["doc_id"]]
        assert (r["held_out"], r["n_known"], r["n_tokens"]) == (held(r["doc_id"]), known, n)
        assert r["base_score"] == pytest.approx(base, rel=1e-9) and r["score"] == pytest.approx(log, rel=1e-5)
        assert r["train_tokens"] == sum(len(t.split()) + 1 for t in train)
    assert score_documents(docs(spark, [])).count() == 0
    alone = next(i for i in range(1000) if held(i))
    assert score_documents(docs(spark, [(alone, "a b", "s")])).first()["train_tokens"] == 0


def shingle_sets(rows):
    out = {}
    for i, t, _ in rows:
        w = (t or "").lower().split()
        out[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    return out


def smallest_reachable(ids, linked):
    comp = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a, b in linked:
            low = min(comp[a], comp[b])
            if comp[a] != low or comp[b] != low:
                comp[a] = comp[b] = low
                changed = True
    return comp


def test_near_dedup_equals_brute_force(spark):
    rng = np.random.default_rng(7)
    rows, n = [], 0
    for _ in range(12):
        base = [f"v{int(x)}" for x in rng.integers(0, 5000, rng.integers(20, 150))]
        for _ in range(10):
            w = list(base)
            for _ in range(int(rng.integers(0, 3))):
                w[int(rng.integers(len(w)))] = "Changed"
            rows.append((n, " ".join(w), "s"))
            n += 1
    chain = [f"c{i}" for i in range(300)]  # each like the next, the ends unlike
    rows += [(n + k, " ".join(chain[8 * k : 8 * k + 200]), "s") for k in range(8)]
    rows += [(900, None, "s"), (901, "", "s"), (902, "a b", "s"), (903, "A  b", "s"), (904, "a b c", "s"), (905, LONG, "s"), (906, LONG.upper(), "s")]
    sets = shingle_sets(rows)
    ids = list(sets)
    linked = [(a, b) for k, a in enumerate(ids) for b in ids[:k] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    comp = smallest_reachable(ids, linked)
    got = by_id(near_dedup(docs(spark, rows)))
    assert [(r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in got] == [(i, len(sets[i]), comp[i], comp[i] == i) for i in sorted(ids)]
    assert near_dedup(docs(spark, [])).count() == 0


def test_embeddings_equal_brute_force(spark):
    rng = np.random.default_rng(8)
    rows, n = [], 0
    for _ in range(10):
        c = rng.standard_normal(16)
        for _ in range(12):
            rows.append((n, (c + rng.standard_normal(16) * rng.choice([0.1, 0.3, 0.45])).astype(np.float32).tolist()))
            n += 1
    rows += [(n + k, rows[0][1]) for k in range(3)] + [(n + 10, [2 * x for x in rows[0][1]])]
    rows += [(800, None), (801, [0.0] * 16), (802, [float("nan")] + [1.0] * 15), (803, [float("inf")] + [1.0] * 15), (804, [None] + [1.0] * 15), (805, []), (806, [1.0, 0.0]), (807, [1.0, 0.1]), (808, [1e30] * 16), (809, [1e-30] * 16)]
    good = {i: np.array(v, float) for i, v in rows if v and None not in v and np.isfinite(v).all() and any(v)}
    unit = {i: v / np.abs(v).max() for i, v in good.items()}
    unit = {i: v / np.linalg.norm(v) for i, v in unit.items()}
    linked = [(a, b) for a in good for b in good if b < a and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.9]
    comp = smallest_reachable([i for i, _ in rows], linked)
    table = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<float>, label int, node string")
    got = {r["vec_id"]: r for r in embedding_dedup(table).collect()}
    assert {i: (r["n_links"], r["component_id"], r["kept"]) for i, r in got.items()} == {i: (sum(i in p for p in linked), comp[i], comp[i] == i) for i, _ in rows}
    assert embedding_dedup(table.limit(0)).count() == 0
