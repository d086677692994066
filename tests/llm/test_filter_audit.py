"""The filter audit against plain Python over all orders."""

import itertools
import re
from collections import defaultdict

import pytest

from alleleloom.llm import filter_audit

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.mark.parametrize("n", range(1, 7))
def test_swaps_visit_each_order_once(n):
    order, seen = list(range(n)), {tuple(range(n))}
    for k in filter_audit.swaps(n):
        order[k], order[k + 1] = order[k + 1], order[k]
        assert tuple(order) not in seen
        seen.add(tuple(order))
    assert seen == set(itertools.permutations(range(n)))


def failures(rows):
    """Each row's part and the letters that it fails."""
    ids = defaultdict(list)
    for r in rows:
        ids[r[1] or ""].append(r[0])
    for r in rows:
        text = r[1] or ""
        words = WORDS.findall(text)
        smaller = any(i is not None and (r[0] is None or i < r[0]) for i in ids[text])
        tests = {
            "A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 10 * len(text),
            "D": bool(re.search(r"[#$%&*|]", text)), "E": smaller,
        }
        yield r[0], r[2] or "", {c for c, t in tests.items() if t}


def audited(rows, labels):
    good, toxic = ({i for i, q, t in labels if (q, t)[k] == 1} for k in (0, 1))
    of, out, shapley = defaultdict(list), {}, defaultdict(int)
    for i, part, fails in failures(rows):
        of[part].append((i, fails))
    for part, docs in of.items():
        for order in itertools.permutations("ABCDE"):
            left = docs
            for step, c in enumerate(order, 1):
                gone = [d for d in left if c in d[1]]
                left = [d for d in left if c not in d[1]]
                shapley[part, c] += len(gone)
                all_fails = sum(c in d[1] for d in docs)
                out[part, "".join(order), step] = (
                    len(left), len(gone), all_fails - len(gone), sum(d[1] == {c} for d in docs), sum(d[0] in good for d in gone), sum(d[0] in toxic for d in gone),
                )
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_audit_agrees_with_plain_python(spark, docs, rows, labels):
    """Null ids, texts and parts, equal rows, copies over several parts, labels that disagree or name no document."""
    more = [(500 + k, rows[k % 7][1], (None, "de", "")[k % 3], "s", 1, "x", 1, 0.5) for k in range(40)] + [(None, rows[3][1], None, "s", 1, "x", 1, 0.5)] * 2
    every = docs.unionByName(spark.createDataFrame(more, docs.schema))
    got = filter_audit.audit_documents(every, labels).collect()
    want = audited([*rows, *more], [tuple(r) for r in labels.collect() if r[0] is not None])
    assert len(got) == len(want) == 3 * 600
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    assert {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in names) for r in got} == want
    assert all(r["filter"] == r["filter_order"][r["step"] - 1] for r in got)


def test_audit_of_no_rows_and_of_too_many_filters(spark, empty, labels):
    assert filter_audit.audit_documents(empty, labels).count() == 0
    with pytest.raises(ValueError):
        filter_audit.audit(spark.createDataFrame([("", 0, 1, 0, 0)], "part string, mask int, n long, good long, toxic long"), list("ABCDEFGHI"))
