"""Times the headline queries; prints one JSON line."""

from __future__ import annotations

import importlib
import json
import os
import sys
import time

HEADLINE = (
    "chunk_stats", "chunk_walk", "finf_decode", "pcm8_widen", "pcm16_le", "lcw_roundtrip", "westwood_commands", "codebook_asof", "vpt_render", "ppm_dump",
    "vptr_pixels", "resumed_frames", "soundtrack_sums", "hicolor_convert", "indexed_convert",
)


def kernels() -> dict[str, float]:
    """Microseconds of the decoder's kernels, single thread, best of 15 runs: 640x400 frames of 4x2 blocks, and 100,000 samples."""
    import numpy as np

    from cinelith.functions import codecs
    from cinelith.operators import container, video

    rng = np.random.default_rng(1)

    def decoder(**values: int) -> video.Decoder:
        plain = {"version": 2, "width": 640, "height": 400, "block_width": 4, "block_height": 2, "colors": 256} | values
        return video.Decoder(container.Header({name: plain.get(name, 0) for name, _, _ in container.FIELDS}, (0,) * 5))

    def best(work) -> float:
        times = []
        for _ in range(15):
            began = time.perf_counter()
            work()
            times.append(time.perf_counter() - began)
        return round(min(times) * 1e6, 1)

    eight, high = decoder(), decoder(version=3, colors=0)
    n = len(eight.blocks)
    eight.set_codebook(rng.bytes(0xF00 * 8))
    eight.set_palette(rng.bytes(768))
    high.set_codebook(rng.bytes(4000 * 16))
    table = bytes(np.concatenate([rng.integers(0, 256, n), rng.integers(0, 16, n)]).astype(np.uint8))
    singles = (0x6000 | rng.integers(0, 4000, n)).astype("<u2").tobytes()
    mixed = b"".join((0xA000 | int(e)).to_bytes(2, "little") + b"\x04" + (0x6000 | int(e)).to_bytes(2, "little") + (3).to_bytes(2, "little") for e in rng.integers(0, 4000, n // 8))
    packed = codecs.lcw_literals(rng.bytes(100_000))
    sound = rng.bytes(50_000)
    took = {
        "frame_8bit": best(lambda: (eight.draw_table(table), eight.frame())), "frame_hicolor_singles": best(lambda: (high.draw_stream(singles), high.frame())),
        "frame_hicolor_mixed": best(lambda: (high.draw_stream(mixed), high.frame())), "lcw_literals_100kB": best(lambda: codecs.lcw(packed, 100_000)),
        "ima_100k_samples": best(lambda: codecs.ima(sound)), "ima_stereo_100k_samples": best(lambda: codecs.ima_stereo(sound, 3, (0, 0), (0, 0))),
    }
    indexed, coloured = eight.frame(), high.frame()
    return took | {"rgb_8bit": best(indexed.rgb), "rgb_hicolor": best(coloured.rgb)}


def main() -> None:
    from pyspark.sql import SparkSession

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    every = importlib.import_module("__spark_entry__").queries()
    wanted = sys.argv[1:] or [n for n in every if n in HEADLINE or n.startswith("op")]
    took = {}
    for name in wanted:
        best = None
        for _ in range(2 if name in HEADLINE else 1):
            began = time.perf_counter()
            every[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            spent = time.perf_counter() - began
            best = spent if best is None else min(best, spent)
        took[name] = round(best, 3)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/")), "kernels_us": kernels()}))


if __name__ == "__main__":
    main()
