"""python -m tidewell encode|decode|info IN [OUT]"""

from __future__ import annotations

import argparse
import os
import sys
from dataclasses import replace

from tidewell.codec import frame
from tidewell.codec.quantize import DEFAULT_SEED, Lossy
from tidewell.codec.schema import guess_stride


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="tidewell", description="Frame files: encode, decode, describe.")
    p.add_argument("what", choices=["encode", "decode", "info"])
    p.add_argument("source")
    p.add_argument("target", nargs="?")
    p.add_argument("--type", dest="kind", help="element type; detected if not given")
    p.add_argument("--preset", choices=list(frame.PRESETS), default="balanced")
    p.add_argument("--block-size", type=int, default=64 << 10)
    p.add_argument("--stride", default="0", help="record width, or auto")
    p.add_argument("--dim", type=int, default=256)
    p.add_argument("--bits", type=int, default=8)
    p.add_argument("--seed", default=hex(DEFAULT_SEED), help="hexadecimal, with or without 0x")
    a = p.parse_args(argv)
    with open(a.source, "rb") as f:
        data = f.read()
    try:
        if a.what == "info":
            reader = frame.FrameReader(data, need_seek_table=False)
            h = reader.head
            print(f"version {h.version}, type {h.kind.name}, parser {h.parser}, {h.size} bytes in {h.blocks} blocks of {h.block_size}, stride {h.stride}, digest {h.digest}, seek table {h.seek_table}, ratio {h.size / len(data):.2f}")
            for b in reader.table():
                print(f"block {b['block_id']}: {b['size']} -> {b['packed_size']} at {b['offset']}, crc32 {b['crc32']:08x}")
            return 0
        if a.what == "decode":
            out = frame.decompress(data)
        else:
            stride = guess_stride(len(data), a.source) if a.stride == "auto" else int(a.stride)
            lossy = Lossy(a.dim, a.bits, int(a.seed, 16)) if (a.kind or "").endswith("pq") else None
            out = frame.compress(data, replace(frame.PRESETS[a.preset], kind=a.kind, block_size=a.block_size, stride=stride, lossy=lossy))
    except ValueError as e:
        print(f"{type(e).__name__}: {e}", file=sys.stderr)
        return 1
    target = a.target or (a.source.removesuffix(".frame") + ".out" if a.what == "decode" else a.source + ".frame")
    with open(f"{target}.part", "wb") as f:
        f.write(out)
    os.replace(f"{target}.part", target)
    return 0


if __name__ == "__main__":
    sys.exit(main())
