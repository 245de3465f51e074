from gridscope.operators import layout as L


def grid(rows, merges=(), bold=(), formulas=None):
    cells = {}
    for r, row in enumerate(rows, 1):
        for c, v in enumerate(row, 1):
            if v is None:
                continue
            kind = "num" if isinstance(v, (int, float)) and not isinstance(v, bool) else "bool" if isinstance(v, bool) else "str"
            cells[r, c] = L.Cell(kind, str(v), (formulas or {}).get((r, c)), bold=(r, c) in bold)
    for m in merges:
        for r in range(m[0], m[2] + 1):
            for c in range(m[1], m[3] + 1):
                cell = cells.setdefault((r, c), L.Cell(None))
                cell.master = (m[0], m[1])
    return L.Grid(cells, list(merges))


BASE = [["pref", "2020", "2021", "2022"]] + [[f"p{i}", 100 + i, 200 + i, 300 + i] for i in range(5)]


def test_plain_table():
    (t,), others = L.detect(grid(BASE))
    assert (t.top, t.left, t.bottom, t.right) == (1, 1, 6, 4)
    assert t.header_rows == [1] and t.body_start == 2 and not others
    assert t.headers[1] == "pref" and t.types == {1: "text", 2: "numeric", 3: "numeric", 4: "numeric"}
    assert t.stubs == [1] and t.confidence == 1.0


def test_bands():
    assert L.bands([5, 1, 2, 9, 3]) == [(1, 3), (5, 5), (9, 9)]
    assert L.bands([]) == []


def test_two_tables_and_empty_sheet():
    tables, _ = L.detect(grid(BASE + [[None] * 4, [None] * 4] + BASE))
    assert [t.top for t in tables] == [1, 9]
    assert L.detect(grid([])) == ([], [])


def test_title_total_note_and_source_go():
    rows = [["statistics"]] + BASE + [["合計", 1, 2, 3], ["※ note", None, None, None], ["出典 x", None, None, None]]
    (t,), others = L.detect(grid(rows))
    assert (t.top, t.bottom) == (2, 7)
    assert {(r, k) for r, _, _, k in others} == {(1, "title"), (8, "total"), (9, "note"), (10, "source")}


def test_sum_formula_is_a_total():
    rows = BASE + [["x", 10, 20, 30]]
    (t,), others = L.detect(grid(rows, formulas={(7, 2): "=SUM(B2:B6)"}))
    assert t.bottom == 6 and {k for *_, k in others} == {"total"}


def test_bold_header_joins_body_over_a_blank_row():
    rows = [BASE[0], [None] * 4, *BASE[1:]]
    (t,), _ = L.detect(grid(rows, bold={(1, c) for c in range(1, 5)}))
    assert t.top == 1 and t.header_rows == [1]


def test_merged_header_labels():
    rows = [["pref", "values", None, None], [None, "a", "b", "c"]] + [[f"p{i}", 100 + i, 200, 300] for i in range(6)]
    (t,), _ = L.detect(grid(rows, merges=[(1, 2, 1, 4), (1, 1, 2, 1)]))
    assert t.header_rows == [1, 2] and t.headers[3] == "values / b" and t.headers[1] == "pref"


def test_headerless_numbers():
    (t,), _ = L.detect(grid([[1, 2, 3]] * 4))
    assert t.header_rows == [] and t.body_start == 1


def test_neighbours_join_and_single_columns_are_isolated():
    wide = [r[:2] + [None] + r[2:] for r in BASE]
    tables, _ = L.detect(grid(wide))
    assert [(t.left, t.right) for t in tables] == [(1, 5)]
    tables, others = L.detect(grid([["a"], ["b"]]))
    assert tables == [] and {k for *_, k in others} == {"isolated"}


def test_inherited_header():
    above = L.Region(1, 1, 3, 2, header_rows=[1], body_start=2, body_end=3, headers={1: "a", 2: "b"})
    below = L.Region(5, 1, 7, 2, body_start=5, body_end=7)
    assert L.inherit([below, above])[1].headers == {1: "a", 2: "b"}


def test_column_vote():
    assert L.vote({"numeric": 8, "text": 2}) == "numeric"
    assert L.vote({"numeric": 7, "text": 3}) == "mixed"
    assert L.vote({"empty": 3}) == "empty"
