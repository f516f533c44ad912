import hashlib
from collections import Counter

import corpus_pipeline
import xxhash
from test_quality_mixing import filled, measured
from test_suffix import brute
from tokenizers import Tokenizer

from tidemark.llm import quality, suffix


def test_stages_return_documents(spark, docs, tmp_path):
    folder = str(tmp_path)
    docs.select(corpus_pipeline.COLUMNS).write.parquet(f"{folder}/documents.parquet")
    now = spark.read.parquet(f"{folder}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, now, folder)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == corpus_pipeline.COLUMNS, name
        out.write.parquet(f"{folder}/{k}")
        now = spark.read.parquet(f"{folder}/{k}")
    assert sorted(map(repr, now.collect())) == sorted(map(repr, corpus_pipeline.run(spark, folder).collect()))


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def kept_by_rules(text):
    """The threshold table on plainly counted measures."""
    t = text or ""
    words = [w.decode() for w in t.encode().split()]
    n, chars, symbols, dup_lines, repeated = measured(t)
    lines = [x for x in t.split("\n") if x.encode().split()]
    ratio = lambda a, b: a / b if b else 0.0
    known = {
        "n_words": n,
        "repeat_word_ratio": ratio(repeated, n),
        "mean_word_length": ratio(chars, n),
        "symbols_per_word": ratio(symbols, n),
        "stop_word_ratio": ratio(sum(lower(w).rstrip(".,;:!?") in quality.STOP_WORDS for w in words), n),
        "duplicate_line_ratio": ratio(dup_lines, len(lines)),
        "ellipsis_line_ratio": ratio(sum(x.encode().rstrip().decode().endswith(("...", "…")) for x in lines), len(lines)),
        "upper_case_ratio": ratio(sum("A" <= c <= "Z" for c in t), len(t)),
    }
    return all((r.low is None or known[r.measure] >= r.low) and (r.high is None or known[r.measure] <= r.high) for r in quality.RULES)


def text_hash(text, seed=42):
    value = seed if text is None else xxhash.xxh64(text.encode(), seed=seed).intdigest()
    return value - (1 << 64) if value >= 1 << 63 else value


def one_of_each_class(rows):
    """rows (id, text, source): exact Jaccard of five-word shingles, linked at 0.8, the smallest (id, hash) of each class."""
    rows = list({(i, t): (i, t, s) for i, t, s in rows if i is not None}.values()) + [r for r in rows if r[0] is None]
    shingles = []
    for _, t, _ in rows:
        w = lower(t).encode().split()
        shingles.append({b" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))})
    group = list(range(len(rows)))

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(shingles[a] & shingles[b])
            if both >= 0.8 * (len(shingles[a]) + len(shingles[b]) - both) - 1e-9 and both:
                group[find(a)] = find(b)
    best = {}
    for k, (i, t, _) in enumerate(rows):
        if i is not None:
            best[find(k)] = min(best.get(find(k), (i, text_hash(t))), (i, text_hash(t)))
    return [r for k, r in enumerate(rows) if r[0] is None or best[find(k)] == (r[0], text_hash(r[1]))]


def mixed(rows):
    """rows (id, text, source), each as often as the seeded mix takes it."""
    size = lambda t: len((t or "").encode().split())
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += size(t)
    targets, out = filled(sizes), []
    seed = xxhash.xxh64((42).to_bytes(4, "little"), seed=42).intdigest()

    def place(i, t):
        own = seed if i is None else xxhash.xxh64(i.to_bytes(8, "little", signed=True), seed=seed).intdigest()
        return text_hash(t, own) if t is not None else (own - (1 << 64) if own >= 1 << 63 else own)

    for s in sizes:
        own = sorted(((place(i, t) % 1024, place(i, t), i is not None, i or 0, t) for i, t, x in rows if x == s), key=lambda r: r[:4])
        whole = int(targets[s] // sizes[s]) if sizes[s] else 0
        extra, start = targets[s] - whole * sizes[s], 0
        for _, _, has_id, i, t in own:
            n = size(t)
            copies = whole + (start + n / 2 < extra if n else 0)
            start += n
            out += [(i if has_id else None, t, s)] * (copies if sizes[s] and n else 0)
    return out


def test_pipeline_equals_brute_force(spark, docs, tmp_path):
    """Every row of run() against plain Python over the same documents."""
    given = docs.select(corpus_pipeline.COLUMNS).filter("doc_id is not null").dropDuplicates(["doc_id"])
    given.write.parquet(f"{tmp_path}/documents.parquet")
    rows = [(r.doc_id, r.text, r.source) for r in given.collect()]
    rows = one_of_each_class([r for r in rows if kept_by_rules(r[1])])
    assert 10 < len(rows) < 60
    ranked = [(suffix.NULL_ID if i is None else i, (t or "").encode()) for i, t, _ in rows]
    cut = brute(ranked, 50)
    rows = [(i, None if t is None else cut[rank][4].decode("utf-8", "ignore"), s) for (i, t, s), rank in zip(rows, ranked, strict=True)]
    library = Tokenizer.from_file(corpus_pipeline.public_tokenizers.path("word_bpe_49k.json"))
    want = []
    for i, t, _ in mixed(rows):
        ids = library.encode(t or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
    assert sorted(want) == sorted(tuple(r) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())


def test_empty_corpus(spark, empty, tmp_path):
    empty.select(corpus_pipeline.COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
