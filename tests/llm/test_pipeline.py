import hashlib
import math

from conftest import DATA
from test_decontaminate import brute as judged
from test_mixing import poisson_inverse
from test_simhash import brute as grouped
from test_tokens import brute as encoded

import corpus_pipeline
from sheaf.llm.queries import QUERIES


def test_against_brute_force_stages(llm):
    docs = {r["doc_id"]: r for r in llm.read.parquet(f"{DATA}/documents.parquet").collect()}
    good = [r["doc_id"] for r in QUERIES["op9_quality"](llm, DATA).collect() if r["score"] >= 0.5]
    single = [d for d, _, c in grouped([(d, docs[d]["text"]) for d in good]) if d == c]
    items = [tuple(r) for r in llm.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    clean = [r[0] for r in judged([(d, docs[d]["text"]) for d in single], items) if not r[5]]
    size = {}
    for d in clean:
        size[docs[d]["source"]] = size.get(docs[d]["source"], 0) + len(docs[d]["text"])
    total, wish = sum(size.values()), sum(map(math.sqrt, size.values()))
    mixed = []
    for d in clean:
        own = size[docs[d]["source"]]
        u = (int(hashlib.md5(f"mix-1:n:{d}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        mixed += [d] * poisson_inverse(math.sqrt(own) / wish * total / own, u)
    rows = corpus_pipeline.run(llm, DATA).collect()
    assert sorted(((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in rows), key=str) == encoded([(d, docs[d]["text"]) for d in mixed])
    assert 0 < len(clean) < len(single) < len(good) < len(docs)


def test_stages_keep_the_columns_of_documents(llm, none):
    docs = none.select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(llm, docs, DATA)
        assert out.columns == docs.columns and out.count() == 0
    assert corpus_pipeline.STAGES[-1][1](llm, docs, DATA).count() == 0
