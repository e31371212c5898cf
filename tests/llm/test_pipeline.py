import hashlib
import random

import numpy as np
import public_tokenizers as P
import tiktoken
from test_operators import WORD, estimated, mcd, prose, squared, template_pairs

import corpus_pipeline
from millrace.llm import byte_bpe, robust_outliers, secret_forest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, secrets string, h long, text_hash long, item_id long, kept boolean"
ITEM = "If the merchant Alice sells 12 crates of apples each day for 5 weeks then how many crates of apples will Alice have sold when the season ends"


def documents():
    r = random.Random(31)
    rows = []
    for i in range(260):
        words = prose(i, r.randrange(55, 90), 3000).split()
        if i % 40 == 7:
            words = [w + "$$$$###" for w in words]
        text = "\n".join(" ".join(words[k : k + 12]) for k in range(0, len(words), 12))
        if i % 50 == 3:
            text += "\n" + ITEM
        if i % 50 == 4:
            text += "\n" + ITEM.replace("Alice", "Roberta").replace("12", "77")
        if i % 30 == 5:
            text += f'\ntoken = "{hashlib.sha1(str(i).encode()).hexdigest()}" here'
        rows.append((i, text, "en" if i % 3 else "de", f"s{i % 4}"))
    rows += [(1000 + i, rows[i][1] + " tail", *rows[i][2:]) for i in range(0, 60, 2)] + [(5, rows[5][1], *rows[5][2:]), (5, rows[9][1] + " other text of one id", "en", "s1")]
    rows += [(None, prose(900, 70, 3000), "en", None), (None, rows[20][1], "en", "s2"), (None, prose(901, 80, 3000), None, "s0"), (2000, None, "en", "s0"), (2001, "", "en", "s0"), (2002, "too short", "en", "s0")]
    rows += [(2003, prose(902, 30000, 3000), "en", "s0"), (1 << 62, prose(903, 60, 3000), "en", "s1")]
    return rows


def quality(rows):
    vectors, failed = [], []
    for _, text, _, _ in rows:
        words = WORD.findall(text or "")
        seen = {}
        for k in range(len(words) - 2):
            seen.setdefault(tuple(words[k : k + 3]), []).append(k)
        repeated = {p for at in seen.values() if len(at) > 1 for k in at for p in range(k, k + 3)}
        lines = [x for x in (text or "").split("\n") if WORD.search(x)]
        n = max(len(words), 1)
        parts = (np.log(1 + sum(map(len, words)) / n), np.log(1 + sum(c in "#*$%&|<>" for c in text or "") / n), (len(lines) - len(set(lines))) / max(len(lines), 1), len(repeated) / n)
        vectors.append(np.floor(1000 * np.array(parts) + 0.5))
        failed.append(len(words) < 50 or 100 * len(repeated) > 50 * len(words))
    groups = {}
    for i, (_, _, lang, source) in enumerate(rows):
        if not failed[i]:
            for key in ((lang, source), (lang, "*")):
                groups.setdefault(key, []).append(vectors[i])
    best = {k: mcd(np.array(v)) for k, v in groups.items()}
    out = []
    for i, row in enumerate(rows):
        if not failed[i]:
            (m, s, ss), (pm, ps, pss) = best[row[2], row[3]], best[row[2], "*"]
            w = robust_outliers.PRIOR / pm
            if squared(vectors[i][None], estimated(m + robust_outliers.PRIOR, s + w * ps, ss + w * pss))[0] <= robust_outliers.CUTOFF:
                out.append(row)
    return out


def deduplicate(rows):
    sets = []
    for _, text, _, _ in rows:
        words = [w.lower() for w in WORD.findall(text or "")]
        sets.append({tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 75 * len(a | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, row in enumerate(rows):
        if row[0] is not None:
            least[find(i)] = min(least.get(find(i), row[0]), row[0])
    return [row for i, row in enumerate(rows) if row[0] == least.get(find(i))]


def test_pipeline_against_brute_force(spark, tmp_path):
    rows = documents()
    frame = spark.createDataFrame([(*x, None if x[1] is None else len(x[1]), "s", 1, 2, 3, False) for x in rows], SCHEMA)
    frame.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, ITEM), (2, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    kept = quality(rows)
    single = deduplicate(kept)
    clean = [x for x in single if not template_pairs({0: x[1]}, {0: ITEM})]
    forest = secret_forest.train()
    texts = [(x[0], secret_forest.redact(x[1], secret_forest.find([x[1]], forest)[1][0])) for x in clean]
    assert len(rows) > len(kept) > len(single) > len(clean) and sum("<secret>" in t for _, t in texts) > 3
    assert {x[0] for x in kept} >= {None, 1 << 62, 2003} and all(name == corpus_pipeline.STAGES[i][0] for i, name in enumerate(("quality", "near_duplicates", "decontaminate", "secrets", "byte_bpe")))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for (_, stage), wanted in zip(corpus_pipeline.STAGES, (kept, single, clean), strict=False):
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        assert sorted(map(repr, (tuple(x)[:4] for x in out.collect()))) == sorted(map(repr, wanted))
        path = str(tmp_path / f"stage-{len(wanted)}-{stage.__name__}")
        out.write.parquet(path)
        docs = spark.read.parquet(path)
    encoding = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    wanted = [(i, len(ids := encoding.encode_ordinary(t)), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()) for i, t in texts]
    got = corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, wanted))


def test_pipeline_of_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
