import numpy as np

from saffron.llm import toxicity
from tests.llm.rows import ODD, docs


def model():
    clean, bad = "the cat sat on the mat. it was a fine day.\n", "you vile wretched fool, begone."
    texts = [clean * (1 + i % 3) for i in range(40)] + [clean * (i % 3) + bad + " " + clean for i in range(40)]
    return toxicity.fit(texts, [0] * 40 + [1] * 40), clean, bad


def test_the_sentences_of_a_toxic_document_are_found(spark):
    trained, clean, bad = model()
    rows = [*ODD, (90, clean + bad + " " + clean), (91, clean), (92, "Grüße. " + bad)]
    out = toxicity.located(docs(spark, rows, clash=True), trained).collect()
    assert len(out) == len(rows)
    by_id = {r["doc_id"]: r for r in out}
    for r in out:
        assert (r["n_offending"] > 0) == (r["predicted"] == 1) and r["n_offending"] == len([x for x in r["spans"].split(",") if x])
    for i, text in ((90, rows[-3][1]), (92, rows[-1][1])):
        found = [text[int(a) : int(b)] for a, b in (x.split(":") for x in by_id[i]["spans"].split(","))]
        assert by_id[i]["predicted"] == 1 and any("vile wretched" in x for x in found) and not any("fine day" in x for x in found)
    assert by_id[91]["predicted"] == 0 and by_id[91]["spans"] == ""
    assert toxicity.located(docs(spark, []), trained).count() == 0


def test_a_document_is_the_noisy_or_of_its_sentences():
    import pyarrow as pa

    trained, clean, bad = model()
    for text in (clean + bad + clean, bad, clean, "a", ""):
        each = [p for _, _, p in trained.offending(text, 0.0)]
        assert np.isclose(trained.scores(pa.array([text]))[0], 1 - np.prod([1 - p for p in each]), atol=1e-6)
