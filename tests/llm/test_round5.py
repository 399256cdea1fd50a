import random

import pytest

from lectern.llm import jaccard, setjoin, spotsigs


def _plain(text):
    """Signatures as tuples of words."""
    words = text.encode("utf-8", "surrogatepass").translate(spotsigs._TABLE).split()
    content = [i for i, w in enumerate(words) if w not in spotsigs.COMMON]
    chain = lambda i: tuple(words[k] for k in content if k > i)[: spotsigs.CHAIN]
    found = {("^", *chain(-1))} if content else set()
    found |= {(w, *chain(i)) for i, w in enumerate(words) if w in spotsigs.COMMON and chain(i)}
    if not content or len(content) == len(words):
        found.add(("=", *words) if words else ("", text))
    return found


def test_signatures_of_many_texts_at_once():
    """Chains stay inside their text, and texts share as many hashes as they share chains."""
    r = random.Random(3)
    vocabulary = ["the", "a", "of", "für", "x", "yy", "Zed", "más", "é", "12", " ", "\n", ".", "\ud800", "", "the-"]
    texts = ["".join(r.choice(vocabulary) + r.choice((" ", "", ", ")) for _ in range(r.choice((0, 1, 2, 3, 5, 9, 30)))) for _ in range(300)]
    got, want = [set(x.tolist()) for x in spotsigs.signature_sets(texts)], [_plain(t) for t in texts]
    assert all(len(a & b) == len(c & d) for a, c in zip(got, want) for b, d in zip(got, want))
    assert all((spotsigs.signatures(t) == sorted(s)).all() for t, s in zip(texts, got)) and spotsigs.signature_sets([]) == []


@pytest.mark.parametrize("parts", [False, True])
def test_pairs_of_near_copies_meet_once(spark, monkeypatch, parts):
    """Copies that stay under the limit share many tokens; a pair of them makes one row, not one for each."""
    r = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    texts = {i: " ".join(w for w in words if r.random() < 0.84) for i in range(20)}
    texts |= {20 + i: texts[i].rpartition(" ")[0] for i in range(4)}
    made = []
    kept = setjoin._met

    def met(*args):
        out = kept(*args)
        made.append((out.count(), out.distinct().count()))
        return out

    monkeypatch.setattr(setjoin, "_met", met)
    docs = spark.createDataFrame(list(texts.items()), "key long, body string")
    part_of = (lambda n: spotsigs.length_part(n, 80, 100)) if parts else None
    found = setjoin.linked_groups(docs, lambda x: jaccard.shingle_sets(x, 1), 80, 100, "bigint", part_of)
    got = {x.key: (x.group, x.links) for x in found.collect()}
    sets = {k: set(t.split()) for k, t in texts.items()}
    linked = {k: {j for j in sets if 100 * len(sets[j] & sets[k]) >= 80 * len(sets[j] | sets[k])} for k in sets}
    group = dict(zip(sets, sets))
    for _ in sets:
        group = {k: min(group[j] for j in linked[k]) for k in sets}
    assert {k: g for k, (g, _) in got.items()} == group and len(set(group.values())) > 3
    rows, pairs = made[0]
    assert pairs >= 20 and rows <= 1.2 * pairs
