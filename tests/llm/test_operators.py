import hashlib
import random
import re
import textwrap
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import regex
import tiktoken

from millrace.llm import byte_bpe, difference_cover, hyperminhash, licence_sentences, pseudo_likelihood, quote_links, repair_grammar, robust_outliers, secret_forest, template_windows, word_bpe

SCHEMA = "doc_id long, text string, lang string, source string, secrets string, h long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def prose(seed, n, vocabulary=400):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    shared = prose(99, 60)
    base = prose(1, 120)
    near = " ".join(base.split()[:118] + ["x", "y"])
    return [
        None, "", " \n\t", "one two", base, base, near, prose(2, 90) + "\n" + shared, shared + " " + prose(3, 70), prose(4, 3000),
        "the same line\nthe same line\n" * 30, "a b c " * 50, "é ü   ß 中文 '' \x1f", "token = \"24be64439e3e49cf46b2d7c90f3602a3d0b907ff\" end.",
    ]


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "en", "s0" if i % 3 else None, "x", 1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_quality_statistics_and_verdicts(docs, texts, empty):
    got = by_id(robust_outliers.quality_rules(docs))
    for i, t in enumerate(texts):
        words = WORD.findall(t or "")
        counts = Counter(tuple(words[k : k + 3]) for k in range(len(words) - 2))
        covered = {p for k in range(len(words) - 2) if counts[tuple(words[k : k + 3])] > 1 for p in range(k, k + 3)}
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_repeat_words"], r["n_dup_lines"]) == (len(words), sum(map(len, words)), len(covered), len(lines) - len(set(lines)))
        assert r["n_symbols"] == sum(c in "#*$%&|<>" for c in t or "")
        assert r["base_failed"] == (len(words) < 50 or 100 * len(covered) > 50 * len(words))
    assert robust_outliers.quality_rules(empty).collect() == []


def test_quality_rejects_outliers(spark):
    rows = [(i, prose(i, 80), "en", "s", "", 1) for i in range(120)] + [(900, " ".join(w + "###$$$" for w in prose(7, 80).split()), "en", "s", "", 1)]
    got = by_id(robust_outliers.quality_rules(spark.createDataFrame(rows, SCHEMA)))
    assert not got[900]["kept"] and all(got[i]["kept"] for i in range(120))


def mcd(x):
    """Sums of the subset with the least determinant, by numpy."""
    M = robust_outliers
    half = lambda v: np.sort(v)[(len(v) + 1) // 2 - 1]

    def sums(rows):
        return len(rows), rows.sum(axis=0), rows.T @ rows

    def nearest(d2):
        bins = np.floor(M.BINS * np.log2(d2 + 0.001))
        return x[bins <= np.sort(bins)[int(np.ceil(len(x) * M.SHARE)) - 1]]

    mid = np.array([half(v) for v in x.T])
    spread = np.array([half(abs(v - m)) for v, m in zip(x.T, mid)])
    z = (x - mid) ** 2 / ((spread * 1.4826) ** 2 + M.FLOORS)
    state = [sums(nearest(d)) for d in (z.sum(axis=1), *z.T, z.max(axis=1))]
    for _ in range(M.STEPS):
        after = [sums(nearest(squared(x, estimated(*s)))) for s in state]
        old, new = ([np.linalg.det(estimated(*s)[1]) for s in of] for of in (state, after))
        state = after
        if not any(b < (1 - M.REST) * a for a, b in zip(old, new)):
            break
    return state[int(np.argmin(new))]


def estimated(m, s, ss):
    mean = s / m
    cov = ss / m - np.outer(mean, mean)
    return mean, cov * robust_outliers.CONSISTENCY + np.diag(robust_outliers.FLOORS)


def squared(x, estimate):
    apart = x - estimate[0]
    return np.einsum("ni,ij,nj->n", apart, np.linalg.inv(estimate[1]), apart)


def test_quality_against_brute_force(spark):
    """Groups of one row up to hundreds, with outliers; distances by the same steps in numpy."""
    r = random.Random(6)
    rows = []
    for i in range(700):
        lang, source = r.choice([("en", "a"), ("en", "a"), ("en", "b"), ("de", "a"), (None, None)]) if i % 90 else ("en", f"rare{i}")
        words = [f"{r.choice('abc')}{r.randrange(10 ** r.randrange(1, 7))}" for _ in range(r.randrange(50, 90))]
        if i % 23 == 0:
            words = [w + r.choice(["###", "$$$$$$$", "xxxxxxxxxxxxxxxxxxxxx"]) for w in words]
        if i % 31 == 0:
            words[:12] = words[12:24]
        lines = "\n".join(" ".join(words[k : k + 10]) for k in range(0, len(words), 10))
        rows.append((i, lines + "\nsame line\nsame line" * (i % 17 == 0), lang, source))
    stats = robust_outliers._vector(robust_outliers.text_statistics(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"))).collect()
    vectors = {x["doc_id"]: np.array([x[d] for d in robust_outliers.DIMS], float) for x in stats}
    got = by_id(robust_outliers.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")))
    fit = {k: [i for i, _, lang, source in rows if k in ((lang, source), (lang, "*")) and not got[i]["base_failed"]] for _, _, lang, source in rows for k in ((lang, source), (lang, "*"))}
    best = {k: mcd(np.array([vectors[i] for i in ids])) for k, ids in fit.items() if ids}
    for i, _, lang, source in rows:
        if not got[i]["base_failed"]:
            (m, s, ss), (pm, ps, pss) = best[lang, source], best[lang, "*"]
            weight = robust_outliers.PRIOR / pm
            d2 = squared(vectors[i][None], estimated(m + robust_outliers.PRIOR, s + weight * ps, ss + weight * pss))[0]
            assert got[i]["d2"] == pytest.approx(d2, rel=1e-6, abs=1e-9) and got[i]["kept"] == (d2 <= robust_outliers.CUTOFF)
    assert 10 < sum(not x["kept"] for x in got.values()) < 100


def test_byte_bpe_as_tiktoken(docs, texts, empty):
    path = P.path("byte_bpe_multi_50k.tiktoken")
    e = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.read_ranks(path), special_tokens={})
    got = by_id(byte_bpe.round_trip(docs, path, P.PATTERN))
    for i, t in enumerate(texts):
        ids = e.encode_ordinary(t or "")
        assert got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
    assert byte_bpe.round_trip(empty, path, P.PATTERN).collect() == []


def test_perfect_hash():
    for n in (0, 1, 2, 3, 50, 1000, 1024):
        keys = [str(i).encode() for i in range(n)]
        table = byte_bpe.PerfectHash(keys)
        assert sorted(map(table.find, keys)) == list(range(n)) and table.find(b"stranger") == -1


def test_difference_cover_against_brute_force(docs, texts, empty):
    seqs = [WORD.findall(t or "") for t in texts]
    counts = Counter(tuple(s[k : k + 35]) for s in seqs for k in range(len(s) - 34))
    got = by_id(difference_cover.without_repeats(docs))
    for i, s in enumerate(seqs):
        gone = {p for k in range(len(s) - 34) if counts[tuple(s[k : k + 35])] > 1 for p in range(k, k + 35)}
        kept = " ".join(w for p, w in enumerate(s) if p not in gone)
        assert (got[i]["n_words"], got[i]["n_removed"], got[i]["kept_sha256"]) == (len(s), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    assert difference_cover.without_repeats(empty).collect() == []


def test_hyperminhash_against_brute_force(docs, texts, empty):
    sets = []
    for t in texts:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(sets)))
    for _ in sets:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if a and b and 100 * len(a & b) >= 75 * len(a | b):
                    root[i] = root[j] = min(root[i], root[j])
    got = by_id(hyperminhash.near_duplicates(docs))
    assert [(got[i]["n_shingles"], got[i]["component_id"], got[i]["kept"]) for i in range(len(sets))] == [(len(s), root[i], root[i] == i) for i, s in enumerate(sets)]
    assert hyperminhash.near_duplicates(empty).collect() == []


def test_hyperminhash_of_large_ids_and_many_near_copies(spark):
    """Copies of one text with many or few changes: links, chains and strays in one bucket, against brute force."""
    r, base = random.Random(4), prose(50, 160, 5000).split()
    texts = []
    for _ in range(120):
        words = list(base)
        for _ in range(r.randrange(0, 12)):
            words[r.randrange(len(words))] = f"x{r.randrange(10**6)}"
        texts.append(" ".join(words))
    rows = [((1 << 62) + 5 * i if i % 2 else -i, t) for i, t in enumerate(texts)] + [(None, texts[3]), (None, "own words of a text with no id"), (7, texts[3])]
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (t.split() for _, t in rows)]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if 100 * len(a & sets[j]) >= 75 * len(a | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (name, _) in enumerate(rows):
        least[find(i)] = min((x for x in (least.get(find(i)), name) if x is not None), default=None)
    wanted = sorted(((name, len(sets[i]), least[find(i)]) for i, (name, _) in enumerate(rows)), key=repr)
    assert 1 < len(set(map(repr, least.values()))) < 100
    for cell in (hyperminhash.CELL, 2000):
        old, hyperminhash.CELL = hyperminhash.CELL, cell
        got = hyperminhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        hyperminhash.CELL = old
        assert sorted(((x["doc_id"], x["n_shingles"], x["component_id"]) for x in got), key=repr) == wanted


def test_hyperminhash_rows_sent_of_unconnected_members(spark, monkeypatch):
    """Four times the texts that share buckets but no link: fewer rows in cells than pairs' growth of 16, and a near copy of one still found."""
    base, sent, dealt = prose(61, 160, 5000).split(), {}, hyperminhash._dealt
    monkeypatch.setattr(hyperminhash, "CELL_MEMBERS", 8)
    for n in (100, 400):
        r, counts = random.Random(n), []
        # Sixty words of their own at the end leave a similarity of about 0.56 to one another.
        texts = [" ".join(base + [f"x{r.randrange(10**9)}" for _ in range(60)]) for _ in range(n)]
        texts.append(texts[n // 2] + " and more")
        monkeypatch.setattr(hyperminhash, "_dealt", lambda rows, counts=counts: (counts.append(rows.count()), dealt(rows))[1])
        got = by_id(hyperminhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))
        assert [got[i]["component_id"] for i in range(n + 1)] == [*range(n), n // 2]
        # Members in cells come first in each pass, then those in a plausible pair.
        sent[n] = counts[2]
    assert sent[100] > 100 and sent[400] <= 11 * sent[100]


def _thue_morse(a, b):
    out = a
    for _ in range(11):
        out += out.translate(str.maketrans({a: b, b: a}))
    return out


def test_long_patterned_words_are_told_apart(spark):
    """Words that every polynomial modulo a power of two confuses."""
    x, y = _thue_morse("a", "b"), _thue_morse("b", "a")
    rest = prose(1, 60).split()
    rows = [(1, " ".join(w for z in rest for w in (z, x))), (2, " ".join(w for z in rest for w in (z, y)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert [r["n_removed"] for r in difference_cover.without_repeats(docs).collect()] == [0, 0]
    assert {r["component_id"] for r in hyperminhash.near_duplicates(docs).collect()} == {1, 2}


def test_very_long_texts(spark):
    """Texts over one piece of the word hash, with one passage in common."""
    shared = prose(5, 50, 10**6)
    texts = [prose(6, 300000, 10**6) + " " + shared, shared + " " + prose(7, 200000, 10**6), " ".join(["z" * 1_500_000, shared, "z" * 1_500_000])]
    docs = spark.createDataFrame(list(enumerate(texts)) + [(None, texts[1])], "doc_id long, text string")
    got = {(r["doc_id"]): r for r in difference_cover.without_repeats(docs).collect()}
    assert (got[0]["n_removed"], got[2]["n_removed"], got[1]["n_removed"], got[None]["n_words"]) == (50, 50, 200050, 200050)
    near = {r["doc_id"]: r["component_id"] for r in hyperminhash.near_duplicates(docs).collect()}
    assert near == {0: 0, 1: 1, 2: 2, None: 1}


def test_repair_round_trip():
    r = np.random.default_rng(0)
    for ids in (np.zeros(0, np.uint32), np.array([2], np.uint32), np.full(5000, 7, np.uint32), r.integers(0, 30, 20000).astype(np.uint32), np.tile(r.integers(0, 49000, 50), 200).astype(np.uint32)):
        shard = repair_grammar.Shard(repair_grammar.pack(ids))
        assert (shard.ids(0, len(ids)) == ids).all()
        for _ in range(20):
            a, b = sorted(r.integers(0, len(ids) + 1, 2).tolist())
            assert (shard.ids(a, b) == ids[a:b]).all()
    assert len(repair_grammar.pack(np.tile(np.arange(50), 200))) < 4 * 10000


def test_repair_of_many_copies():
    ids = np.tile(np.random.default_rng(3).permutation(40000)[:500], 1000).astype(np.uint32)
    sequence, rules, _ = repair_grammar.compress(ids)
    assert len(sequence) < 1000 and (repair_grammar.Shard(repair_grammar.pack(ids)).ids(0, len(ids)) == ids).all()


def test_word_bpe_as_tokenizers(texts, monkeypatch):
    """Texts with all kinds of characters, special tokens and long words, one by one and by column, with a small memory too."""
    r = random.Random(1)
    wild = ["ΑΣ ΟΔΟΣ Σ", "İstanbul'S DON'T we'RE ''s !'s x'll", "a\x1cb \x85 c\u3000d", "emoji \U0001f600 ok", "<|endoftext|> hi <|start", "a <|startoftext|>b", "A\u030a \u0308x e\u0301 ǅ ß ẞ ² ½ ٣ 中文字", "z" * 5000, "힣 각", "Ⅷ ⅷ Ω ﬁ"]
    wild += ["".join(chr(r.choice([r.randrange(32, 127), r.randrange(160, 0x600), r.randrange(0x1E00, 0x2200), r.randrange(0xA0, 0xD7FF)])) for _ in range(80)) for _ in range(150)]
    encoder = word_bpe.Encoder(P.path("word_bpe_49k.json"))
    assert encoder.known
    every = [t or "" for t in texts] + wild
    wanted = [[*x.ids, 2] for x in encoder.library.encode_batch(every, add_special_tokens=False)]
    for words, pieces in ((1 << 20, 400_000), (64, 10)):
        monkeypatch.setattr(word_bpe, "WORDS", words)
        monkeypatch.setattr(word_bpe, "MEMORY", pieces)
        monkeypatch.setattr(word_bpe, "PIECES", pieces)
        for encode in (encoder.encode, lambda x, end: encoder.encode_column(pa.array(x, pa.string()), end)):
            for _ in range(2):
                ids, counts = encode(every, 2)
                assert counts.tolist() == list(map(len, wanted)) and ids.tolist() == [x for w in wanted for x in w]
    other = word_bpe.Encoder(P.path("byte_bpe_50k.json"))
    ids, counts = other.encode_column(pa.array(["Some text", None]), 9)
    assert not other.known and ids.tolist() == [*other.library.encode("Some text").ids, 9, 9] and counts.tolist() == [len(ids) - 1, 1]


def test_repair_files_as_tokenizers(docs, texts, empty):
    from tokenizers import Tokenizer

    encoder = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    got = by_id(repair_grammar.read(repair_grammar.write(docs, P.path("word_bpe_49k.json"))))
    start = 0
    for i, t in enumerate(texts):
        ids = np.array([*encoder.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert repair_grammar.read(repair_grammar.write(empty, P.path("word_bpe_49k.json"))).collect() == []


def test_templates(spark, docs, empty):
    item = "If the merchant Alice sells 12 crates of apples each day for 5 weeks then how many crates of apples will Alice have sold when the season ends"
    other = item.replace("Alice", "Roberta").replace("12", "31").replace("5", "9")
    mixed = item.replace("Alice", "Roberta", 1)
    benchmark = spark.createDataFrame([(1, item), (2, None), (3, "short"), (4, "")], "item_id long, text string")
    rows = [(1, "So. " + item + ". " + prose(1, 80)), (2, prose(2, 60) + ". " + other), (3, prose(3, 90)), (4, None), (5, prose(4, 30) + ". " + mixed)]
    got = by_id(template_windows.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), benchmark))
    assert set(got) == {1, 2} and got[1]["verbatim"] and not got[2]["verbatim"]
    assert template_windows.contaminated(empty, benchmark).collect() == []


def test_templates_of_another_case_and_names_at_sentence_starts(spark):
    item = "The merchant Alice sells 12 crates of apples each day for 5 weeks. Alice then counts how many crates of apples were sold when the season ends"
    start = "Alice sells 12 crates of apples each day. Then how many of them will Alice have sold when the season of apples ends"
    benchmark = spark.createDataFrame([(1, item), (2, start)], "item_id long, text string")
    other = start.replace("Alice", "Roberta")
    rows = [
        (1, prose(1, 30) + ". " + item.upper()), (2, item.title()), (3, item.upper().replace("12", "70").replace("5", "41")), (4, prose(2, 40)),
        (5, other.split(". ")[0] + ". Then Roberta goes"), (6, other), (7, other.replace("Roberta", "Carol", 1)),
    ]
    got = {(r["doc_id"], r["item_id"]): r for r in template_windows.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), benchmark).collect()}
    assert set(got) == {(1, 1), (2, 1), (3, 1), (6, 2)}
    assert got[1, 1]["verbatim"] and got[2, 1]["verbatim"] and not got[3, 1]["verbatim"] and not got[6, 2]["verbatim"]
    assert got[6, 2]["n_found"] == got[6, 2]["n_windows"]


def test_template_copy_after_an_inconsistent_one(spark):
    item = "If the merchant Alice sells 12 crates of apples each day for 5 weeks then how many crates of apples will Alice have sold when the season ends"
    mixed, other = item.replace("Alice", "Roberta", 1), item.replace("Alice", "Roberta").replace("12", "31")
    rows = [(1, mixed + ". " + prose(1, 40) + ". " + other), (2, mixed + ". " + prose(2, 40) + ". " + mixed)]
    benchmark = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = by_id(template_windows.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), benchmark))
    assert set(got) == {1} and got[1]["n_found"] == got[1]["n_windows"]


def template_modes(text):
    """(raw, typed, slots, capital) of each mode, by plain Python."""
    name, number, unit, join = "\ue000", "\ue001", "\ue002", "\ue003"
    base = regex.sub(r"\p{Z}", " ", text)
    marked = regex.sub(r"(?<=[^.!?\s]\s)(?=\p{Lu})", name, base)
    clean = lambda t: regex.sub(r"\s+", " ", regex.sub(rf"[^\p{{L}}\p{{M}}\p{{N}}\s{name}{join}]+", "", t)).strip()
    runs = lambda t, mark: regex.sub(rf"(?<={mark}\p{{Lu}}[\p{{L}}\p{{M}}]{{0,40}})\s(?={mark}\p{{Lu}})", join, t)

    def typed(t):
        out = [number if w in template_windows.NUMBER_WORDS else w for w in regex.sub(r"\p{N}\S*", number, t).lower().split(" ")]
        return [unit if i and out[i - 1][-1:] == number and w in template_windows.UNITS else w for i, w in enumerate(out)]

    found = {}
    for mode, words, typing, slots in (("named", runs(marked, name), 0, 0), ("capital", runs(base, ""), 1, 1), ("folded", marked, 2, 0), ("plain", marked, 3, 3)):
        words = clean(words)
        plain = words.replace(name, "")
        forms = [typed(regex.sub(rf"{name}\S+", name, words)), typed(regex.sub(r"(?<!\S)\p{Lu}\S*", name, plain)), typed(plain), plain.lower().split(" ")]
        if words:
            found[mode] = forms[3], forms[typing], forms[slots], forms[1]
    return found


def template_pairs(documents, items):
    marks = set("\ue000\ue001\ue002\ue003")
    pairs = {}
    for i, item in items.items():
        of_item, windows = template_modes(item), {}
        for mode, (_, typed, _, _) in of_item.items():
            size = min(10, len(typed))
            places = [k for k in range(len(typed) - size + 1) if sum(not marks & set(w) for w in typed[k : k + size]) >= 6]
            windows[mode] = {k: tuple(typed[k : k + size]) for k in places}
        if any(windows[m] for m in windows if m != "plain"):
            windows.pop("plain", None)
        for d, text in documents.items():
            of_doc, found = template_modes(text), {}
            for mode, wanted in windows.items():
                if not wanted or mode not in of_doc:
                    continue
                (raw, _, slots, caps), (draw, dtyped, _, dcap) = of_item[mode], of_doc[mode]
                size = len(next(iter(wanted.values())))
                met = [(k, p) for p in range(len(dtyped) - size + 1) for k, w in wanted.items() if tuple(dtyped[p : p + size]) == w]
                hit, total = {wanted[k] for k, _ in met}, set(wanted.values())
                if not met or 100 * len(hit) < 30 * len(total):
                    continue
                same = all(any(wanted[k] == w and draw[p : p + size] == raw[k : k + size] for k, p in met) for w in hit)
                names = {r for r, s in zip(raw, slots) if s == "\ue000"}
                good = False
                for shift in {p - k for k, p in met}:
                    values = set()
                    for k, (r, s) in enumerate(zip(raw, slots)):
                        kind = s if s in marks else "\ue000" if mode in ("named", "folded") and caps[k] == "\ue000" and r in names else None
                        if kind and 0 <= k + shift < len(draw) and dcap[k + shift] == kind:
                            values.add((kind, r, draw[k + shift]))
                    good |= len(values) == len({v[:2] for v in values})
                found[mode] = len(hit) / len(total), ("plain", "folded", "capital", "named").index(mode), len(hit), len(total), same, good
            most = max((f[0] for f in found.values()), default=0)
            kept = [(*f[:4], f[4] and f[0] >= most) for f in found.values() if f[5] or (f[4] and f[0] >= most)]
            if kept:
                pairs[d, i] = max(kept)[2:]
    return pairs


def test_templates_against_brute_force(spark):
    r = random.Random(12)
    names, words = ["Alice", "Bob", "Mary Ann", "Von Der Berg", "Zoe"], [f"word{chr(97 + a)}{chr(97 + b)}" for a in range(6) for b in range(5)]

    def item():
        who = r.choice(names)
        out = [r.choice(words) for _ in range(r.randrange(4, 30))]
        for _ in range(r.randrange(5)):
            out[r.randrange(len(out))] = r.choice([who, who, str(r.randrange(90)), f"{r.randrange(9)} miles", "seven days", out[0].title() + ". " + out[1].title()])
        return " ".join(out).capitalize() + "?"

    def other(text):
        def word(w):
            return str(r.randrange(100)) if w.isdigit() else r.choice(["Carol", "Anna Lee", w]) if w in ("Alice", "Bob", "Zoe") else w

        kind = r.randrange(6)
        fixed = r.choice(["Carol", "Anna Lee"])
        if kind == 0:
            return text
        if kind == 1:
            return text.upper()
        if kind == 2:
            return text.replace("Alice", fixed).replace("Mary Ann", fixed).replace("Von Der Berg", fixed).replace("seven", "nine")
        if kind == 3:
            return " ".join(map(word, text.split(" ")))
        if kind == 4:
            return " ".join(text.split(" ")[: r.randrange(6, 20)])
        return text.replace(" ", "\n", 3).replace("Bob", fixed)

    items = {i: item() for i in range(40)}
    documents = {d: ". ".join(" ".join(r.choice(words) for _ in range(r.randrange(12))) if r.random() < 0.4 else other(items[r.randrange(40)]) for _ in range(r.randrange(1, 5))) for d in range(150)}
    wanted = template_pairs(documents, items)
    assert 40 < len(wanted) and {v[2] for v in wanted.values()} == {True, False}
    tables = [spark.createDataFrame(list(x.items()), f"{k} long, text string") for x, k in ((documents, "doc_id"), (items, "item_id"))]
    for anchors in (template_windows.ANCHORS, 3):
        old, template_windows.ANCHORS = template_windows.ANCHORS, anchors
        got = {(x["doc_id"], x["item_id"]): (x["n_found"], x["n_windows"], x["verbatim"]) for x in template_windows.contaminated(*tables).collect()}
        template_windows.ANCHORS = old
        assert got == wanted


def test_templates_of_null_and_repeated_ids_and_clashing_columns(spark):
    item = "If the merchant Alice sells 12 crates of apples each day for 5 weeks then how many crates of apples will Alice have sold when the season ends"
    plain = "12 7 9 44 31 8 2 15"
    schema = "doc_id long, text string, item_id long, t long, h long, mode string, place int, size int, anchor long, raw string"
    rest = (1, 1, 1, "m", 1, 1, 1, "r")
    rows = [(None, item, *rest), (1, item, *rest), (1, item, *rest), (1, "other words", *rest), (2, "then " + plain + " and", *rest), (3, "", *rest), (4, None, *rest)]
    docs = spark.createDataFrame(rows, schema)
    benchmark = spark.createDataFrame([(7, item, 1), (7, item, 2), (8, plain, 3), (9, "too short", 4), (None, item, 5)], "item_id long, text string, t long")
    got = sorted(((x["doc_id"], x["item_id"], x["verbatim"]) for x in template_windows.contaminated(docs, benchmark).collect()), key=repr)
    assert got == sorted([(None, 7, True), (1, 7, True), (None, None, True), (1, None, True), (2, 8, True)], key=repr)


def test_secrets(docs, empty):
    forest = secret_forest.Forest(secret_forest.rule_findings())
    held = secret_forest.rule_findings(1500, 77)
    judged = forest.score(np.array([secret_forest.features(*f[:3]) for f in held])) >= 0.5
    assert (judged == np.array([f[3] == 1 for f in held])).mean() > 0.97
    got = by_id(secret_forest.scan(docs, forest))
    assert got[13]["text"] == 'token = "<secret>" end.' and got[0]["text"] is None and len(got[4]["secrets"]) == 0
    assert secret_forest.scan(empty, forest).collect() == []


def test_secrets_of_any_length():
    forest, r = secret_forest.Forest(secret_forest.rule_findings()), random.Random(8)
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"

    def pick(of, k):
        return "".join(r.choice(of) for _ in range(k))

    base = letters + "0123456789"
    signed = f"eyJhbGciOiJIUzI1NiJ9.ey{pick(base + '-_', 400)}.{pick(base + '-_', 86)}"
    held = [
        f'token = "{signed}"', f"Authorization: Bearer {signed}", f"private_key={pick(base + '+/', 1600)}==", f'secret: "{pick(letters, 32)}"',
        'password = "hunter2257"', "db_password=xK9mQ2vL", 'dbPassword: "xK9mQ2vLr4"', "pwd=t7Gq2Lw9",
    ]
    clean = [
        "-" * 300, "=" * 80, "Donaudampfschifffahrtsgesellschaft is a word", "the monkey: bananas and apples", "this key: value", "see getDefaultConfigValue for it",
        "no password: please", "time: 10.30.00 and access: public", "internationalization of the user interface",
    ]
    counts, found = secret_forest.find([*held, *clean], forest)
    assert [len(x) for x in found] == [1] * len(held) + [0] * len(clean)
    values = [signed, signed, held[2].split("=", 1)[1], held[3].split('"')[1], "hunter2257", "xK9mQ2vL", "xK9mQ2vLr4", "t7Gq2Lw9"]
    assert [t[x[0][0] : x[0][1]] for t, x in zip(held, found, strict=False)] == values


def test_secret_scan_against_brute_force(spark):
    """Every row of a table with nulls, repeated rows, paths and clashing columns, judged one candidate at a time."""
    forest, r = secret_forest.train(), random.Random(44)
    values = ["24be64439e3e49cf46b2d7c90f3602a3d0b907ff", "AKIA" + "Q7" * 8, "docs/source/index/page.html", "hunter2hunter2", "0123456789012345678"]
    texts = [None, "", "x" * 70000, *[f"{prose(i, 5)} {r.choice(['token = ', 'password: ', 'checksum ', 'see ', 'key='])}{r.choice(values)} {prose(i + 1, 3)}\n" * r.randrange(1, 4) for i in range(60)]]
    rows = [(None if i % 9 == 0 else i % 40, t, r.choice([None, "src/tests/a.py", "deploy/prod.env"]), 1, "s", "n") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows + rows[:5], "doc_id long, text string, path string, n_candidates int, secrets string, mark string")
    trees = [list(zip(t.feature, t.threshold, t.left, t.right, t.share)) for t in forest.trees]

    def score(vector):
        total = 0.0
        for tree in trees:
            at = 0
            while tree[at][0] >= 0:
                at = tree[at][2] if vector[tree[at][0]] <= tree[at][1] else tree[at][3]
            total += tree[at][4]
        return total / len(trees)

    wanted = []
    for name, text, path, *_ in rows + rows[:5]:
        spans = []
        for m in secret_forest.CANDIDATE.finditer(text or ""):
            a, b = m.span()
            if m[0].startswith("key="):
                a += 4
            spans.append((a, b))
        short = [(m.start(2), m.end(2)) for m in re.finditer(r"(token = |password: |key=)(hunter2hunter2)", text or "") if not any(a <= m.start(2) < b for a, b in spans)]
        spans = sorted(spans + short)
        found = [(a, b) for a, b in spans if score(secret_forest.features(text[a:b], text[max(0, a - 48) : a], text[b : b + 48], path or "")) >= 0.5]
        wanted.append((name, text if not found else secret_forest.redact(text, found), path, len(spans), found, "n"))
    got = [(x["doc_id"], x["text"], x["path"], x["n_candidates"], [tuple(s) for s in x["secrets"]], x["mark"]) for x in secret_forest.scan(docs, forest).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, wanted)) and 10 < sum(len(w[4]) for w in wanted)


def test_quotes(spark):
    rows = [
        (1, 0, "user", "First line here.\nSecond, line!"), (1, 1, "assistant", "> second line\nA reply"), (1, 2, "user", "> > Second line\n> a reply\nmore"),
        (1, 3, "user", "> never said\nx"), (1, 4, "user", None), (None, 5, "user", "> a reply"), (2, 1, "user", "> second line"),
    ]
    got = {(r["conv_id"], r["turn"]): r for r in quote_links.reply_order(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert [(got[1, i]["parent_turn"], got[1, i]["root_turn"], got[1, i]["depth"]) for i in range(5)] == [(None, 0, 0), (0, 0, 1), (1, 0, 2), (None, 3, 0), (None, 4, 0)]
    assert got[1, 2]["text"] == "more" and got[1, 2]["max_level"] == 2 and got[2, 1]["parent_turn"] is None
    assert quote_links.reply_order(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).collect() == []


def test_quotes_of_later_holders_and_other_line_breaks(spark):
    long = "The first thing to try is a fresh copy of the table. After that the join should be looked at, and the plan of the second stage as well"
    rows = [
        (1, 0, "Thanks.\nHello there"), (1, 1, "An answer of its own"), (1, 2, "Thanks.\nI will look at it tomorrow"), (1, 3, "> Thanks.\nok"),
        (1, 4, "> Thanks.\n> I will look at it tomorrow\nfine"), (1, 5, long), (1, 6, "Thanks."),
        (1, 7, "> The first thing to try is a fresh\n> copy of the table. After that the join\n> should be looked at\nyes"),
        (1, 8, "> After that the join should be looked at, and the plan of the second stage as well\nno"), (1, 9, "> Something that nobody wrote here at all\nno"),
        (2, 0, "one two three four five"), (2, 1, "> one two three\n> four five\nx"), (2, 2, "a first line\na second one"), (2, 3, "> a second one\ny"),
    ]
    rows = [(c, t, "user", x) for c, t, x in rows]
    got = {(r["conv_id"], r["turn"]): r for r in quote_links.reply_order(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    linked = {k: r["parent_turn"] for k, r in got.items() if r["parent_turn"] is not None}
    assert linked == {(1, 3): 2, (1, 4): 2, (1, 7): 5, (1, 8): 5, (2, 1): 0, (2, 3): 2}


def test_quotes_against_brute_force(spark, monkeypatch):
    """Threads with nested, wrapped and partial quotes, and common lines: sources, roots, depths and reply order by plain loops."""
    r = random.Random(21)
    monkeypatch.setattr(quote_links, "SIBLINGS", 4)

    def normal(text):
        return " ".join(regex.findall(r"[\p{L}\p{M}\p{N}]+", text.lower()))

    def passages(text):
        """(level, passage) of consecutive lines of one level."""
        out = []
        for line in (text or "").split("\n"):
            mark = re.match(r"((?:[ \t]*>)*)[ \t]?", line)[0]
            level = mark.count(">")
            if out and out[-1][0] == level:
                out[-1][1].append(line[len(mark) :])
            else:
                out.append((level, [line[len(mark) :]]))
        return [(level, "\n".join(x)) for level, x in out]

    def hashes(text):
        """Counts of normalised passages, lines, sentences and windows, by level."""
        out = Counter()
        for level, p in passages(text):
            words = normal(p).split()
            if words:
                parts = {" ".join(words), *map(normal, p.split("\n")), *map(normal, re.split(r"(?<=[.!?])\s+", p))} - {""}
                parts |= {("window", *words[i : i + 6]) for i in range(len(words) - 5)}
                out.update((level, h) for h in parts)
        return out

    rows = []
    for conv in range(25):
        turns = []
        for turn in range(r.randrange(1, 22)):
            own = ". ".join(" ".join(f"{r.choice('abcdefgh')}{r.randrange(9)}" for _ in range(r.randrange(1, 9))) for _ in range(r.randrange(1, 3))) + r.choice([".", "\nThanks.", ""])
            text = own
            if turns and r.random() < 0.8:
                quoted = r.choice(turns[-6:]) or ""
                if r.random() < 0.4:
                    quoted = quoted.replace("\n", " ")
                if r.random() < 0.3:
                    quoted = "\n".join(textwrap.wrap(quoted.replace("\n", " "), 25)) or quoted
                if r.random() < 0.2:
                    quoted = quoted[: len(quoted) // 2]
                text = "\n".join(("> " if r.random() < 0.7 else ">") + x for x in quoted.split("\n")) + "\n" + own
            turns.append(text)
            rows.append((conv, turn, "user", text))
    rows += [(99, t, "user", f"m{t} body\n" if t == 0 else f"> m{t - 1} body\nm{t} body") for t in range(70)]
    rows += [(98, t, "user", "the only start" if t == 0 else f"> the only start\nreply {t}") for t in range(30)]
    texts = {(c, t): x for c, t, _, x in rows}
    every = {k: hashes(x) for k, x in texts.items()}
    parent, sources = {}, {}
    for (c, t), found in every.items():
        best = {}
        for level in {lv for lv, _ in found if lv > 0}:
            scores = Counter()
            for (lv, h), k in found.items():
                if lv == level:
                    for s in range(t):
                        if every[c, s][0, h]:
                            scores[s] += k
            if scores:
                best[level] = max(scores, key=lambda s: (scores[s], s))
        if best:
            parent[c, t], sources[c, t] = best[min(best)], sorted(best.items())
    children = {}
    for (c, t), p in sorted(parent.items()):
        children.setdefault((c, p), []).append(t)
    wanted = {}
    for c, t in texts:
        if (c, t) not in parent:
            stack, place = [(t, 0)], 0
            while stack:
                node, depth = stack.pop()
                wanted[c, node] = (parent.get((c, node)), t, depth, place)
                place += 1
                stack += [(x, depth + 1) for x in reversed(children.get((c, node), []))]
    assert len(parent) > 200 and max(w[2] for w in wanted.values()) == 69
    extra = spark.createDataFrame([(*x, 1, "p") for x in rows], "conv_id long, turn long, role string, text string, level int, h string")
    got = quote_links.reply_order(extra).collect()
    assert {(x["conv_id"], x["turn"]): (x["parent_turn"], x["root_turn"], x["depth"], x["position"]) for x in got} == wanted
    assert {(x["conv_id"], x["turn"]): [tuple(s) for s in x["sources"]] for x in got if x["sources"]} == sources


def test_licences(spark, empty):
    mit = f"MIT License\n\n{licence_sentences.SENTENCES['mit-grant']}\nsomething\n{licence_sentences.SENTENCES['mit-condition']}"
    rows = [(1, mit), (2, "Some prose. Licensed under CC BY-NC 4.0. More"), (3, None), (4, "no licence here"), (5, licence_sentences.SENTENCES["mit-condition"])]
    got = by_id(licence_sentences.licences(spark.createDataFrame(rows, "doc_id long, text string")))
    assert [got[i]["licences"] for i in range(1, 6)] == [["MIT"], ["CC-BY-NC-4.0"], [], [], []]
    assert licence_sentences.licences(empty).collect() == []


def test_licence_texts_as_wrapped(spark):
    sentence = licence_sentences.SENTENCES
    full = 'the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies'
    assert full in sentence["mit-grant"] and all(any(t in s.lower() for t in licence_sentences._TRIGGERS) for s in sentence.values())

    def wrap(text, mark=""):
        return "\n".join(textwrap.wrap(text, 60, initial_indent=mark, subsequent_indent=mark))

    mit = ["MIT License", "Copyright (c) 2020 A. Holder", sentence["mit-grant"], sentence["mit-condition"], sentence["warranty"]]
    apache = "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at"
    endorse = "3. Neither the name of Example Corp. nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
    bsd = [sentence["bsd-grant"], "1. " + sentence["bsd-source"]]
    gpl = "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."
    rows = [
        (1, "\n\n".join(map(wrap, mit))), (2, "\n".join(mit)), (3, wrap(apache, " * ") + "\n\n    http://www.apache.org/licenses/LICENSE-2.0"),
        (4, "\n\n".join(map(wrap, bsd))), (5, "\n".join(map(wrap, [*bsd, endorse]))), (6, wrap(sentence["gpl-free"], "# ")), (7, "A tool.\n" + wrap(gpl)),
        (8, "prose\nReleased under the MIT License.\nmore"), (9, "// SPDX-License-Identifier: MPL-2.0\nint x;"), (10, "this software is under no such version of a permission"),
    ]
    got = by_id(licence_sentences.licences(spark.createDataFrame(rows, "doc_id long, text string")))
    wanted = ["MIT", "MIT", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "GPL-3.0-or-later", "GPL-2.0-or-later", "MIT", "MPL-2.0"]
    assert [got[i]["licences"] for i in range(1, 11)] == [*([x] for x in wanted), []]


def test_licences_against_brute_force(spark):
    """Sentences and rules found by trying every sentence at every word, on shuffled, wrapped and damaged texts."""
    L, r = licence_sentences, random.Random(9)
    known = {k: v for k, v in L.SENTENCES.items() if "<>" not in v}
    assert len(known) > 400

    def brute(text):
        tokens = [(m[0], m.start(), m.end()) for m in re.finditer(r"[a-z0-9]+", text.lower())]
        border = [True] + [bool(re.search(r"\n|[.!?:;][\"')\]]*\s", text[a[2] : b[1]])) for a, b in zip(tokens, tokens[1:])] + [True]
        found, at = [], 0
        while at < len(tokens):
            best = ("", 0)
            for name, sentence in known.items():
                words = re.findall(r"[a-z0-9]+", sentence.lower())
                if border[at] and [t[0] for t in tokens[at : at + len(words)]] == words and border[at + len(words)] and len(words) > best[1]:
                    best = (name, len(words))
            found += [best[0]] if best[1] else []
            at += best[1] or 1
        held = set()
        for i, name in enumerate(found):
            end = next((j for j in range(i + 1, len(found)) if found[j] == name), len(found))
            options = []
            for licence, wanted in L.RULES:
                j = i
                for w in wanted[1:] if wanted[0] == name else ():
                    j = next((k for k in range(j + 1, end) if found[k] == w), end)
                if wanted[0] == name and j < end:
                    options.append((len(wanted), licence))
            held |= {x for n, x in options if n == max(options)[0]}
        return found, sorted(held)

    names, texts = sorted(known), []
    core = [n for n in names if not n.startswith("notice")]
    for _ in range(40):
        parts = [known[r.choice(r.choice([names, core]))] for _ in range(r.randrange(1, 7))]
        parts = [x if r.random() < 0.8 else x.replace(" the ", " a ", 1) for x in parts] + [prose(r.randrange(99), 8)]
        r.shuffle(parts)
        text = r.choice([" ", "\n", ". "]).join(x + r.choice(["", ".", "\n"]) for x in parts)
        texts.append(r.choice([text, text.upper(), "\n".join(textwrap.wrap(text, 50)), "\n".join(textwrap.wrap(text, 40, initial_indent="# ", subsequent_indent="# "))]))
    grant, source, endorse = known["bsd-grant"], known["bsd-source"], L.SENTENCES["bsd-endorse"].replace("<>", "Some Body")
    rows = list(enumerate(texts)) + [(None, texts[0]), (7, texts[0]), (100, f"{grant}\n{source}\n{endorse}\nother\n{grant}\n{source}"), (101, ""), (102, "x " * 200000 + "\nReleased under GPLv3")]
    docs = spark.createDataFrame([(*x, ["a"], "b", "c") for x in rows], "doc_id long, text string, sentence_ids array<string>, licences string, words string")
    got = L.licences(docs).collect()
    assert len(got) == len(rows) and {r["doc_id"]: r["licences"] for r in got}[102] == ["GPL-3.0-only"] and {r["doc_id"]: r["licences"] for r in got}[100] == ["BSD-2-Clause", "BSD-3-Clause"]
    wanted = [(i, *brute(t)) for i, t in [*enumerate(texts), (None, texts[0]), (7, texts[0])]]
    mine = [(x["doc_id"], x["sentence_ids"], x["licences"]) for x in got if x["doc_id"] is None or x["doc_id"] < 100]
    assert sorted(mine, key=repr) == sorted(wanted, key=repr) and sum(len(w[1]) for w in wanted) > 60


def test_pseudo_likelihood(spark, empty):
    rows = [(i, " ".join(["one two three four five six"] * 40)) for i in range(200)]
    train = spark.createDataFrame(rows, "doc_id long, text string").coalesce(2)
    flat = pseudo_likelihood.train(pseudo_likelihood.coded(train))
    got = by_id(pseudo_likelihood.score(spark.createDataFrame([(1, "one two three four five six"), (2, "six one five three two four"), (3, None)], "doc_id long, text string"), flat))
    assert got[1]["mean_log_likelihood"] > got[2]["mean_log_likelihood"] and got[3]["n_words"] == 0 and got[3]["mean_log_likelihood"] is None
    assert pseudo_likelihood.score(empty).collect() == []


def test_pseudo_likelihood_gradient():
    """Log probabilities against plain loops, their sum over all codes, and a step against numeric differences."""
    M = pseudo_likelihood
    r = np.random.default_rng(2)
    codes, first = r.integers(0, 4096, 40), np.array([0, 0, 7, 8, 40])
    chunk = M.sequence(codes, first)
    assert len(chunk) == 40 + 2 * 5 and (chunk[chunk != 4096] == codes).all()
    flat = (M.start() + r.normal(0, 0.2, len(M.start()))).astype(np.float32)
    p = [x.astype(np.float64) for x in M._views(flat)]

    def plain(p, target=None):
        out = []
        for row in range(4):
            text = codes[first[row] : first[row + 1]].tolist()
            for i, c in enumerate(text):
                near = [text[i + k] if 0 <= i + k < len(text) else 4096 for k in (-2, -1, 1, 2)]
                h = np.tanh(sum(p[0][n] * p[1][k] for k, n in enumerate(near)))
                x1 = h @ p[2] + p[3]
                for t in [c] if target is None else target:
                    x2 = (h + p[4][t // 64]) @ p[5] + p[6]
                    out.append(x1[t // 64] - np.log(np.exp(x1).sum()) + x2[t % 64] - np.log(np.exp(x2).sum()))
        return np.array(out)

    assert np.allclose(M.log_probability(M._views(flat), chunk), plain(p), atol=1e-4)
    assert np.exp(plain(p, range(4096))).sum() == pytest.approx(40)
    parts = np.concatenate([M.log_probability(M._views(flat), c) for c in M.chunks(chunk, 16)])
    assert np.allclose(parts, plain(p), atol=1e-4)
    after = [x.astype(np.float32) for x in p]
    M.step(after, chunk)
    for part, (old, new) in enumerate(zip(p, after)):
        places = np.argwhere(np.abs(new - old) > 1e-4)
        assert len(places)
        for place in places[:: max(1, len(places) // 8)]:
            low, high = ([x.copy() for x in p] for _ in range(2))
            low[part][tuple(place)] -= 1e-4
            high[part][tuple(place)] += 1e-4
            slope = (plain(high).mean() - plain(low).mean()) / 2e-4
            assert (new - old)[tuple(place)] == pytest.approx(M.RATE * slope, rel=0.02, abs=2e-5)


def test_pseudo_likelihood_of_words_with_one_code(spark, monkeypatch):
    names = [f"q{i}" for i in range(20000)]
    column = pa.RecordBatch.from_arrays([pa.array(names)], ["text"])
    _, codes, _ = pseudo_likelihood._coded(column)
    often, rare, unseen = (names[i] for i in np.flatnonzero(codes == codes[0])[:3])
    filler = [w for w, c in zip(names, codes, strict=True) if c != codes[0]][:50]
    train = spark.createDataFrame([(i, f"{often} {often} {often} {rare if i == 0 else often} " + " ".join(filler)) for i in range(40)], "doc_id long, text string")
    table = pseudo_likelihood.coded(train)
    flat, words = pseudo_likelihood.train(table), pseudo_likelihood.vocabulary(table)
    assert {r["n"] for r in words.collect()} == {159, 1, 40} and words.count() == 52
    tested = spark.createDataFrame([(1, often), (2, rare), (3, unseen), (4, f"{rare} {often} {rare}"), (None, rare), (2, rare)], "doc_id long, text string")
    results = []
    for frequent in (1 << 16, 4):
        monkeypatch.setattr(pseudo_likelihood, "FREQUENT", frequent)
        rows = pseudo_likelihood.score(tested, flat, words).collect()
        assert len(rows) == 6
        got = {r["doc_id"]: r["pseudo_log_likelihood"] for r in rows}
        assert got[1] - got[2] == pytest.approx(np.log(159)) and got[2] == got[None] and got[2] - got[3] == pytest.approx(0)
        results.append([got[i] for i in range(1, 5)])
    assert results[0] == pytest.approx(results[1])
