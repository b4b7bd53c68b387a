"""``python -m orbspan.cli --footprints-file f.npy --resolution 4 6``: throughput of the cover."""

from __future__ import annotations

import argparse
import time

from .api import cover_footprint
from .sources.arrays import load_footprints


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description="Time cover_footprint on a file of footprints.")
    parser.add_argument("--footprints-file", required=True)
    parser.add_argument("--resolution", type=int, nargs="+", required=True)
    parser.add_argument("--warmup", type=int, default=1)
    parser.add_argument("--repeats", type=int, default=5)
    given = parser.parse_args(args)
    footprints = load_footprints(given.footprints_file)
    print("resolution", "footprint_s", "mean_s", "total_cells", sep="\t")
    for r in given.resolution:
        seconds = []
        for _ in range(given.warmup + given.repeats):
            began = time.perf_counter()
            found = cover_footprint(footprints, r)
            seconds.append(time.perf_counter() - began)
        mean = sum(seconds[given.warmup :]) / given.repeats
        print(r, f"{len(footprints) / mean:.6f}", f"{mean:.6f}", len(found.cell_ids), sep="\t")


if __name__ == "__main__":
    main()
