"""Faults as data: kinds, causes, places and their messages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

ERROR = T.StructType(
    [
        T.StructField("kind", T.StringType()),
        T.StructField("cause", T.StringType()),
        T.StructField("chunk", T.StringType()),
        T.StructField("offset", T.LongType()),
        T.StructField("frame", T.IntegerType()),
        T.StructField("message", T.StringType()),
    ]
)

# Message texts by kind, and by kind and cause.
KINDS = {
    "NotVqa": "not a VQA file",
    "InvalidHeader": "invalid VQHD header",
    "Truncated": "unexpected end of data",
    "InvalidChunk": "malformed chunk structure",
    "Lcw": "malformed LCW data: {}",
    "TooLarge": "{} exceeds sanity limits",
    "Video": "malformed video data: {}",
}
CAUSES = {
    "FrameSize": "frame size",
    "Codebook": "codebook",
    "Soundtrack": "soundtrack",
    "BadOffset": "copy offset out of range",
    "LcwTruncated": "unexpected end of input",
    "LcwTooLarge": "output exceeds the size limit",
    "MixedCodebookParts": "mixed CBP0/CBPZ parts",
    "PaletteSize": "palette size",
    "WrongPointerFormat": "pointer chunk for the other pixel format",
    "PointerTableSize": "pointer table size mismatch",
    "BlockIndexOutOfRange": "block index outside the codebook",
    "TruncatedPointerStream": "truncated pointer stream",
    "UnknownPointerCommand": "unknown pointer stream command",
    "PointerStreamOverrun": "pointer stream writes past the frame",
}


class Fault(Exception):
    """A decoding fault; place() fills in what inner code did not know."""

    def __init__(self, kind: str, cause: str | None = None, chunk: str | None = None, offset: int | None = None, frame: int | None = None):
        super().__init__(kind, cause)
        self.kind, self.cause, self.chunk, self.offset, self.frame = kind, cause, chunk, offset, frame

    def place(self, chunk: str | None = None, offset: int | None = None, frame: int | None = None) -> Fault:
        if self.offset is None and offset is not None:
            self.chunk, self.offset = chunk, offset
        if self.frame is None:
            self.frame = frame
        return self

    def row(self) -> dict:
        return {"kind": self.kind, "cause": self.cause, "chunk": self.chunk, "offset": self.offset, "frame": self.frame, "message": message(self)}


def message(f: Fault) -> str:
    text = KINDS[f.kind].format(CAUSES.get(f.cause, ""))
    where = [f"frame {f.frame}"] if f.frame is not None else []
    if f.offset is not None:
        where.append((f"{f.chunk} chunk " if f.chunk else "") + f"at offset {f.offset:#x}")
    return f"{text} ({', '.join(where)})" if where else text


def message_column(kind: Column, cause: Column, chunk: Column, offset: Column, frame: Column) -> Column:
    """message() as a Catalyst expression."""
    causes = F.create_map(*[F.lit(x) for kv in CAUSES.items() for x in kv])
    text = F.lit(None).cast("string")
    for k, said in KINDS.items():
        before, _, after = said.partition("{}")
        full = F.concat(F.lit(before), F.coalesce(causes[cause], F.lit("")), F.lit(after)) if "{}" in said else F.lit(said)
        text = F.when(kind == k, full).otherwise(text)
    at = F.concat(F.coalesce(F.concat(chunk, F.lit(" chunk ")), F.lit("")), F.lit("at offset 0x"), F.lower(F.hex(offset)))
    where = F.concat_ws(", ", F.concat(F.lit("frame "), frame.cast("string")), at)
    return F.when(where == "", text).otherwise(F.concat(text, F.lit(" ("), where, F.lit(")")))
