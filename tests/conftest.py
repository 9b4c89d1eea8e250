import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from basketmine.plans.runtime import session
    s = session(master="local[*]", shuffle_partitions=8)
    # Tests run locally: give them their own checkpoint folder only when the
    # session has none configured.
    if not s.sparkContext.getCheckpointDir() and \
            not s.sparkContext.getConf().get("spark.checkpoint.dir", None):
        s.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="basketmine-test-cp-"))
    yield s


# The tiny golden rating file of FIXTURES.md (F1), raw form.
F1_BLOCKS = [
    ("1", ["101,3,2005-01-01", "102,4,2005-01-02", "103,5,2005-01-03", "104,2,2005-01-04"]),
    ("2", ["101,3,2005-01-01", "102,4,2005-01-02", "103,5,2005-01-03"]),
    ("3", ["101,3,2005-01-01", "102,4,2005-01-02", "105,1,2005-01-05"]),
    ("7", ["106,1,2005-01-06"]),
    ("10", ["101,3,2005-01-01", "102,4,2005-01-02", "104,5,2005-01-04"]),
]


def f1_text(normalised: bool = False, final_newline: bool = True) -> str:
    sep = "\n\n" if normalised else "\n"
    text = sep.join(f"{h}:\n" + "\n".join(lines) for h, lines in F1_BLOCKS)
    return text + ("\n" if final_newline else "")


@pytest.fixture
def write_text(tmp_path):
    """Write {name: text} into a fresh folder and return its path."""
    counter = {"n": 0}

    def _write(files: dict[str, str]) -> str:
        counter["n"] += 1
        folder = tmp_path / f"in{counter['n']}"
        folder.mkdir()
        for name, text in files.items():
            (folder / name).write_text(text)
        return str(folder)
    return _write


@pytest.fixture
def f1_ratings(spark, write_text):
    from basketmine.sources.blocks import read_raw_ratings
    return read_raw_ratings(spark, write_text({"combined_data_1.txt": f1_text()}))
