"""License places against plain Python; notices with edits."""

from tests.llm.cases import ALNUM_WORD, SCHEMA, ascii_lower, clashing, edge_docs
from tokenledger.llm import licenses as L


def brute(text):
    words = ALNUM_WORD.findall(ascii_lower(text))
    places, labels = [], set()
    for phrase, label in L.BASE_PHRASES.items():
        p = phrase.split()
        found = [i for i in range(len(words) - len(p) + 1) if words[i:i + len(p)] == p]
        places += found
        labels |= {label} if found else set()
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def check(df):
    out = L.scan_licenses(df).collect()
    got = sorted(((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"])
                  for r in out), key=repr)
    assert got == sorted(((r["doc_id"], *brute(r["text"])) for r in df.select("doc_id", "text").collect()), key=repr)
    assert all(set(r["base_labels"].split(",")) <= set(r["labels"].split(",")) | {""} and 0 <= r["score"] <= 1 for r in out)
    return out


PLANTED = [
    (100, "Licensed under the Apache-License, MIT License and MIT\nlicense; cc by cc BY-NC 4.0", "en", "a", 0),
    (101, "apache license", "en", "a", 0), (102, "Apache", "en", "a", 0), (103, "GNU General Public", "en", "a", 0),
    (104, "the GNU GENERAL PUBLIC LICENSE gnu general public license", "en", "a", 0),
    (105, "mit license " * 300, "en", "a", 0), (106, "public license general gnu mit  apache", "en", "a", 0),
]


def test_planted_and_edge_documents(spark):
    df = edge_docs(spark).unionByName(spark.createDataFrame(PLANTED, SCHEMA)).repartition(3)
    out = {r["doc_id"]: r for r in check(df)}
    assert out[100]["labels"] == "apache,cc-by,cc-by-nc,mit" and out[100]["score"] == 1.0
    assert out[106]["labels"] == "" and out[106]["score"] < 1
    check(clashing(df))
    check(spark.createDataFrame([], SCHEMA))


def test_whole_table(spark):
    check(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))


def test_notices_survive_edits_but_not_shuffles(spark):
    n = L.NOTICES["mit"]
    w = n.split()
    texts = [n, "before " * 30 + n + " after" * 30, " ".join(w[:20] + ["or", "otherwise"] + w[20:40] + w[41:]),
             " ".join(w[:len(w) // 4]), " ".join(w[::-1]), n + " gap " * 50 + n]
    out = {r["doc_id"]: r for r in L.scan_licenses(
        spark.createDataFrame([(i, t, "en", "a", 0) for i, t in enumerate(texts)], SCHEMA)).collect()}
    assert [out[i]["labels"] for i in range(6)] == ["mit", "mit", "mit", "", "", "mit"]
    assert out[1]["spans"][0][0] == 30 and out[0]["score"] == 1.0 and 0.5 <= out[2]["score"] < 1
    assert len(out[5]["spans"]) == 2 and out[3]["score"] < 0.5


def test_phrase_in_every_place_of_a_text_longer_than_a_block(spark):
    docs = [(i, "cc by " * 200_000 if i == 7 else "word cc by " * 40, "en", "a", 0) for i in range(60)]
    out = check(spark.createDataFrame(docs, SCHEMA))
    spans = {r["doc_id"]: r["spans"] for r in out}
    assert len(spans[7]) == 200_000 and tuple(spans[0][0]) == (1, 3, "cc-by")
    thin = L.scan_licenses(spark.createDataFrame(docs, SCHEMA), spans=False)
    assert thin.columns == [c for c in out[0].asDict() if c != "spans"]


def test_a_copy_among_many_quotes_stays_one_chain():
    """Ten quotes of one clause begin between a copy's stretch and its next one, two words on."""
    quotes = [(22 + i, 1, 0, 0) for i in range(10)]
    chains = L._merge([(0, 17, 0, 20), *quotes, (3, 40, 29, 70)])
    assert [(0, 17, 0, 20), (3, 40, 29, 70)] in chains and len(chains) == 11
