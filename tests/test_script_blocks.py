"""Scripts read in blocks against one pass over the same bytes."""

import random

import pytest

from tablevault.operators import script_blocks
from tablevault.operators.restore import read_scripts, split_script_text

PARTS = [
    "INSERT INTO `t` VALUES (1,'a;b');\n", "INSERT INTO `t` VALUES ('it''s\n;\n''','\\'\n;');\n", "-- don't; \"stop\n", "# it's ;\n",
    "/* a comment ; '\n` \" */\n", "/* \n\n !x ' */ SELECT 1;\n", "/*!40101 SET @a = 'x;\n' */;\n", "SELECT `a;\nb``c`;\n", 'SELECT "x;\n\\"y";\n',
    "DELIMITER ;;\nCREATE PROCEDURE p()\nBEGIN\nSELECT ';;';\nSELECT 2;\nEND ;;\nDELIMITER ;\n", "DELIMITER $$\nSELECT 1; $$ SELECT '$$\n' $$\n$$\n",
    "DELIMITER ;\n", "\n", "  \n;\n", "SELECT 1; SELECT 2; SELECT\n3;\n", "x" * 90 + "\n", "'" + "y" * 120 + "\n';\n", "SELECT 'é\r\n\U0001F600';\r\n"]


def script(rng, many):
    tail = rng.choice(["", "SELECT 'open\n", "SELECT 5", "/* open\n\n", "DELIMITER //\nSELECT 1 //\n", "\n\n"])
    return "".join(rng.choice(PARTS) for _ in range(many)) + tail


@pytest.mark.parametrize("size", [1, 7, 64, 300])
def test_blocks_compose(size, tmp_path):
    """Entry states and positions, without Spark."""
    rng = random.Random(size)
    for n in range(150):
        text = script(rng, rng.randint(0, 12))
        (tmp_path / "s").write_bytes(text.encode())
        data = text.encode()
        with open(tmp_path / "s", "rb") as handle:
            blocks = [script_blocks.block_bytes_of(handle, b, len(data), size) for b in range(-(-len(data) // size))]
        assert b"".join(blocks) == data
        context, delimiter, held, out = "", b";", b"", []
        for block in blocks:
            pieces, rest, after, left = script_blocks.scan(block, context, delimiter)
            # an exit context does not depend on the delimiter, and the delimiter only on lines that name one
            _, _, same, named = script_blocks.scan(block, context, script_blocks.UNCHANGED)
            assert same == after and left == (delimiter if named == script_blocks.UNCHANGED else named)
            context, delimiter = after, left
            for piece in pieces:
                out.append(held + piece)
                held = b""
            held += rest
        out = [p.strip().decode() for p in [*out, held] if p.strip()]
        assert out == split_script_text(text), text


@pytest.mark.parametrize("size", [50, 400, 5000])
def test_read_scripts_in_blocks(spark, tmp_out, size):
    rng = random.Random(size)
    texts = {f"{i}.sql": script(rng, many) for i, many in enumerate([0, 1, 30, 200, 60])}
    texts["plain.sql"] = "".join(f"INSERT INTO `t` VALUES ({i},'x');\n" for i in range(300))
    for name, text in texts.items():
        with open(f"{tmp_out}/{name}", "wb") as f:
            f.write(text.encode())
    got = {}
    for r in read_scripts(spark, tmp_out, block_bytes=size).collect():
        got.setdefault(r.file.rsplit("/", 1)[1], []).append((r.pos, r.stmt))
    for name, text in texts.items():
        want = list(enumerate(split_script_text(text)))
        assert sorted(got.get(name, [])) == want, name


def test_a_statement_over_many_blocks(spark, tmp_out):
    long = "INSERT INTO `t` VALUES ('" + "line\n;" * 4000 + "');"
    with open(f"{tmp_out}/a.sql", "w") as f:
        f.write("SELECT 1;\n" + long + "\nSELECT 2;\n")
    got = sorted((r.pos, r.stmt) for r in read_scripts(spark, tmp_out, block_bytes=1000).collect())
    assert got == [(0, "SELECT 1;"), (1, long), (2, "SELECT 2;")]


def test_many_small_blocks_share_tasks(spark, tmp_out):
    """The number of tasks follows the bytes, not the blocks."""
    texts = [f"/* {i} ; it's\n\"open */\nINSERT INTO `t` VALUES ({i},'x');" for i in range(2000)]
    with open(f"{tmp_out}/a.sql", "w") as f:
        f.write("\n".join(texts) + "\n")
    found = read_scripts(spark, tmp_out, block_bytes=40)
    assert found.rdd.getNumPartitions() <= 8 * spark.sparkContext.defaultParallelism
    got = sorted((r.pos, r.stmt) for r in found.collect())
    assert got == list(enumerate(texts))
