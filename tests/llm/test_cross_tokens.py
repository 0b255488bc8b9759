import hashlib
import json
from collections import Counter

import pytest
import sentencepiece
import tokenizers

from tests.llm.helpers import AWKWARD, documents, store
from vigil.llm import cross_tokens, queries
from vigil.llm.common import table, tokenizer_path

TEXTS = [
    *AWKWARD, "  ", "a ", "a  ", "a  b", " a", "a\n b", "a\n  b", "▁ a", "a▁b", "<|endoftext|> x<|endoftext|> </s>", "a\x1c b", "a\x85 b", "a　 b ​ c",
    "don't they've 'll 12345 3.14", "same words here", "same words here", "naïve déjà vu 東京 タワー 🙂🙂", "x" * 3000 + " tail", "\t\ttab  tab \t", "\r\n \r\n",
]


@pytest.fixture(scope="module")
def files():
    return [cross_tokens.read_file(tokenizer_path(n)) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model")]


def spelling(files):
    spec = json.loads(files[0])["model"]["vocab"]
    chars = cross_tokens._byte_characters()
    a = {i: bytes(chars.index(c) for c in t) for t, i in spec.items()}
    model = sentencepiece.SentencePieceProcessor(model_proto=files[1])
    return a, model, lambda i: bytes([int(model.id_to_piece(i)[3:5], 16)]) if model.is_byte(i) else model.id_to_piece(i).replace("▁", " ").encode()


def brute(texts, files):
    """Every pair of tokens compared, by the libraries' own encoders on whole texts."""
    bytes_a, model, bytes_b = spelling(files)
    own = tokenizers.Tokenizer.from_str(files[0].decode())
    own.encode_special_tokens = True
    out, held = [], Counter()
    for t in texts:
        ids_a, ids_b = own.encode(" " + t, add_special_tokens=False).ids if t else [], model.encode(t) if t else []
        ranges = []
        for ids, spelled in ((ids_a, bytes_a.get), (ids_b, bytes_b)):
            at, found = 0, []
            for i in ids:
                found.append((at, at + len(spelled(i)), i))
                at += len(spelled(i))
            ranges.append(found)
        if not t or any(b"".join(map(f, ids)) != (" " + t).encode() for f, ids in ((bytes_a.get, ids_a), (bytes_b, ids_b))):
            out.append((0, 0, 0, [], ""))
            continue
        links = [(x[2], y[2]) for x in ranges[0] for y in ranges[1] if x[0] < y[1] and y[0] < x[1]] if len(ids_a) < 3000 else None
        ends = sorted({x[1] for x in ranges[0]} & {y[1] for y in ranges[1]})
        groups, start = [], 0
        for end in ends:
            groups.append("|".join(",".join(str(x[2]) for x in r if start < x[1] <= end) for r in ranges))
            start = end
        held.update(set(links))
        out.append((len(ids_a), len(ids_b), len(ends), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    best = {}
    for (a, _), n in held.items():
        best[a] = max(best.get(a, 0), n)
    return [(a, b, g, len(k), sum(held[p] == best[p[0]] for p in k), sum(held[p] for p in k), sha) for a, b, g, k, sha in out]


@pytest.mark.parametrize("most_pairs", [cross_tokens.MOST_PAIRS, 0])
def test_equals_brute_force(spark, files, most_pairs):
    docs = documents(spark, TEXTS).repartition(3)
    rows = cross_tokens.judge(docs, *files, most_pairs=most_pairs).collect()
    assert docs.columns == [c for c in rows[0].asDict() if c != "aligned"]
    names = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    assert [tuple(r.aligned[n] for n in names) for r in sorted(rows)] == brute(TEXTS, files)


def test_windows_cut_nothing(files, monkeypatch):
    import pyarrow as pa

    texts = pa.array(TEXTS)
    whole = cross_tokens._found(cross_tokens.aligner(*files), texts)
    monkeypatch.setattr(cross_tokens, "WINDOW", 7)
    assert cross_tokens._found(cross_tokens.aligner(*files), texts).equals(whole)
    monkeypatch.setattr(cross_tokens, "MOST_RUNS", 3)
    assert cross_tokens._found(cross_tokens.aligner(*files), texts).equals(whole)


def test_query(spark, sf, files):
    rows = sorted(queries.op13_cross_tokens(spark, sf).collect())
    given = sorted((r.doc_id, r.text) for r in table(spark, sf, "documents").collect())
    # documents of moderate size by brute force; counts need all, so only what a document alone gives is compared
    small = [(r, t) for r, (_, t) in zip(rows, given) if len(t or "") < 1500]
    expected = brute([t for _, t in small], files)
    assert len(rows) == len(given) and len(small) > 20
    assert [(r.n_a, r.n_b, r.n_groups, r.n_links, r.groups_sha256) for r, _ in small] == [(*e[:4], e[6]) for e in expected]


def test_groups_spell_the_text(spark, files):
    a, _, b = spelling(files)
    for r in cross_tokens.groups(documents(spark, TEXTS), *files).collect():
        whole = (" " + (r.text or "")).encode()
        for g in r.groups:
            assert b"".join(map(a.get, g.a)) == b"".join(map(b, g.b)) == whole[g.start : g.end]
        assert [g.start for g in r.groups] == [0, *(g.end for g in r.groups)][: len(r.groups)] and (not r.groups or r.groups[-1].end == len(whole))


def test_every_byte_level_token_is_made_by_its_own_rule(files):
    """So that merging by the least id can never join a pair that no rule joins."""
    spec = json.loads(files[0])["model"]
    rank = {tuple(m if isinstance(m, list) else m.split(" ")): i for i, m in enumerate(spec["merges"])}
    for token in spec["vocab"]:
        parts = list(token)
        while len(parts) > 1:
            least = min((rank.get(p, len(rank)), i) for i, p in enumerate(zip(parts, parts[1:])))
            if least[0] == len(rank):
                break
            parts[least[1] : least[1] + 2] = ["".join(parts[least[1] : least[1] + 2])]
        assert parts == [token] or token == "<|endoftext|>"


def test_characters_split_alike(files):
    own = tokenizers.Tokenizer.from_str(files[0].decode())
    ours = cross_tokens.aligner(*files).a
    texts = ["".join(f"a{chr(c)}1 {chr(c)}" for c in range(at, at + 64) if not 0xD800 <= c < 0xE000) for at in range(0, 0x32000, 64)]
    texts = [t for t in texts if t]
    assert ours.encode(texts) == [e.ids for e in own.encode_batch([" " + t for t in texts], add_special_tokens=False)]


def test_empty_and_clashing_names(spark, files, tmp_path):
    docs = documents(spark, ["a few words", "a few words"]).selectExpr("*", "'own' AS aligned", "'own' AS row", "'own' AS pair", "'own' AS n", "'own' AS best", "'own' AS _aligned_", "'own' AS _own0_")
    rows = cross_tokens.judge(docs, *files).collect()
    assert len(rows) == 2 and all(r.aligned == r.row == r.pair == r._aligned_ == r._own0_ == "own" and r.aligned_.n_a > 0 for r in rows)
    assert rows[0].aligned_ == rows[1].aligned_
    assert cross_tokens.judge(docs.limit(0), *files).count() == 0
    assert queries.op13_cross_tokens(spark, store(docs.limit(0), tmp_path)).count() == 0
