from tideline.llm.lines import drop_repeated_lines

LONG = "a line that several documents share"


def brute(rows, min_docs=2, min_chars=10):
    key = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(" \t\n\x0b\f\r"))
    holders = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= min_chars:
                holders.setdefault(key(line), set()).add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        keep = [x for x in lines if len(holders.get(key(x), ())) < min_docs or i == min(h for h in holders[key(x)] if h is not None)]
        out.append((i, "\n".join(keep), len(lines), len(lines) - len(keep)))
    return sorted(out, key=repr)


def result(frame):
    return sorted(((r["row"]["doc_id"], r["text"], r["n_lines"], r["n_dropped"]) for r in frame.collect()), key=repr)


def test_against_brute_force(docs):
    rows = [
        (3, f"one\n {LONG.upper()}\ttwo"), (1, f"{LONG}\nown line of document one"), (2, f"\t{LONG}  \n{LONG}\nshort\n"),
        (9, "short\nshort\nÉtude en ligne assez longue"), (8, "étude en ligne assez longue"), (7, "\n\n"), (6, None), (5, ""),
        (4, f"{LONG}\x00\n" + "x" * 50_000), (10, "x" * 50_000),
    ]
    assert result(drop_repeated_lines(docs(rows))) == brute(rows)


def test_repeated_rows_decide_alike(docs):
    rows = [(1, LONG), (1, LONG), (2, f"{LONG}\nb"), (2, f"{LONG}\nb"), (2, f"{LONG}\nother text")]
    assert result(drop_repeated_lines(docs(rows))) == brute(rows)


def test_rows_without_an_id_come_last(docs):
    found = result(drop_repeated_lines(docs([(None, LONG), (None, LONG), (4, LONG)])))
    assert [(i, n) for i, _, _, n in found] == [(4, 0), (None, 1), (None, 1)]


def test_no_rows_and_thresholds(docs):
    assert result(drop_repeated_lines(docs([]))) == []
    rows = [(1, LONG), (2, LONG), (3, LONG)]
    assert result(drop_repeated_lines(docs(rows), min_docs=4)) == brute(rows, min_docs=4)
