import random

from corvane.operators.chunking import STRIP, chunk_text


def spans(text, target=800):
    return [(c["start_line"], c["end_line"], c["content"]) for c in chunk_text(text, target)]


def test_blocks_stay_whole_and_hide_headings():
    text = "# Parent\nintro\n\n````\n# in code\n```\n\n````\n~~~\n# tilde\n\n~~~\n$$\n# in math\n\n$$\n\n## Child\nend"
    chunks = chunk_text(text, 5)
    assert [c["heading_path"] for c in chunks][-1] == "Parent > Child"
    assert all("in code" not in c["heading_path"] and "in math" not in c["heading_path"] for c in chunks)
    assert any("````\n# in code\n```\n\n````" in c["content"] and "$$\n# in math\n\n$$" in c["content"] for c in chunks)


def test_spans_give_back_the_content():
    rng = random.Random(0)
    pool = ["# A", "## B b", "### C", "", " ", "text", "```", "````", "~~~", "$$", "$$ x $$", "#none", "x" * 30, "  ```", "    ```", "####### no"]
    for _ in range(300):
        text = "\n".join(rng.choice(pool) for _ in range(rng.randrange(0, 30)))
        lines, covered = text.split("\n"), 0
        for a, b, content in spans(text, rng.choice([1, 20, 80])):
            assert covered < a <= b <= len(lines)
            assert "\n".join(lines[a - 1 : b]).strip(STRIP) == content
            assert not "".join(lines[covered : a - 1]).strip(STRIP)
            covered = b
        assert not "".join(lines[covered:]).strip(STRIP)


def test_levels_pop_and_long_lines_stay():
    assert [c["heading_path"] for c in chunk_text("x\n# a\n### b\n## c\n# d")] == ["Root", "a", "a > b", "a > c", "d"]
    assert spans("y" * 5000) == [(1, 1, "y" * 5000)]
    assert spans("a" * 10 + "\r\n\r\nb", 10) == [(1, 2, "a" * 10), (3, 3, "b")]
    assert spans("") == [] and spans("\n \n") == []
    # Lengths count UTF-16 units: four characters beyond the first plane are eight units.
    assert len(spans("😀😀😀😀\n\nb", 10)) == 2 and len(spans("abcd\n\nb", 10)) == 1
