"""The state of a stream of alignments is small, and reads come out of it as they went in."""

import pickle

import numpy as np
import pandas as pd

from tagplane.streaming.pairing import packed, unpacked


def test_state_is_small_and_whole():
    n = 20_000
    reads = pd.DataFrame(
        {"qname": [f"q.{k * 7}" for k in range(n)], "ord": np.arange(n) % 3, "chr": np.where(np.arange(n) % 2, "chrA", "chrB"), "end": np.arange(n, dtype="int32") * 31 % 19_000,
         "signed": np.arange(n, dtype="int32") * -31 % 19_000, "header_ord": [1.0, None] * (n // 2), "bad": np.arange(n) % 5 == 0, "marked": np.arange(n) % 9 == 0}
    )
    state = packed(reads.sample(frac=1, random_state=1))
    assert len(state) * 3 < len(pickle.dumps(reads))
    pd.testing.assert_frame_equal(unpacked(state), reads.sort_values(["qname", "ord"]).reset_index(drop=True))


def test_reads_without_names():
    reads = pd.DataFrame({"qname": [None, None], "ord": [1, 2], "chr": [None, None], "header_ord": [None, None]})
    assert unpacked(packed(reads))["ord"].tolist() == [1, 2]
