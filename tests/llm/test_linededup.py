from collections import defaultdict

import pytest

from tickertone.llm import linededup


def brute(rows, sites):
    seen, home = defaultdict(set), {}
    for doc_id, text, _, source in rows:
        for line in (text or "").split("\n"):
            key = line.strip(" \t\x0b\x0c\r")
            if key:
                seen[key] |= {source} - {None}
                home[key] = min([x for x in (home.get(key), doc_id) if x is not None], default=None)
    out = []
    for doc_id, text, _, _ in rows:
        kept = []
        for line in (text or "").split("\n"):
            key = line.strip(" \t\x0b\x0c\r")
            if not key or len(seen[key]) < sites or home[key] is not None and home[key] == doc_id:
                kept.append(line)
        lines = (text or "").split("\n")
        out.append((doc_id, "\n".join(kept) if len(kept) < len(lines) else text, len(lines), len(lines) - len(kept)))
    return sorted(out, key=str)


def found(table, sites):
    return sorted([(r.doc_id, r.text, r.n_lines, r.n_removed) for r in linededup.without_boilerplate(table, sites).collect()], key=str)


@pytest.mark.parametrize("sites", [1, 3, 8, 60])
def test_against_brute_force(docs, sites):
    rows = [(i, f"own {i}\nfooter\n\n  wide {i % 70} \nnear {i % (sites + 1)}\nfooter", "en", f"s{i % 100}") for i in range(400)]
    rows += [(i, "near lines " + "x" * 3 + f"\nk{i % 3}", "en", f"t{i % sites}") for i in range(500, 500 + sites)]
    rows += [(900, None, "en", "s1"), (901, "", "en", "s1"), (902, "\n \n", "en", "s2"), (None, "footer\nnull id", "en", None), (903, "footer", "en", None), (0, rows[0][1], "en", "s0"), (3, rows[3][1], "en", "s3")]
    rows += [(904, "footer\n" * 20_000 + "end", "en", "s4")]
    assert found(docs(rows), sites) == brute(rows, sites)


def test_columns_and_empty_table(docs):
    assert linededup.without_boilerplate(docs([])).collect() == []
    assert linededup.without_boilerplate(docs(["x"])).columns == [*docs([]).columns, "n_lines", "n_removed"]
