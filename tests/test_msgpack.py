import io
import json
import struct
import tempfile

import pytest

from tidewater.sources import ir, msgpack

MODULES = [
    {"module_id": "m1", "target_triple": "x86", "functions": [{"name": "f" * 300, "return_type": "ptr", "params": ["ptr %p"], "blocks": [
        {"label": "entry", "successors": ["b1"], "instructions": [{"opcode": "call", "dest": "%1", "operands": ["i64 8"] * 20, "callee": "malloc", "raw": "é" * 40}] * 17}, {"label": "b1", "successors": [], "instructions": [{"opcode": "ret", "dest": None, "operands": [], "callee": None, "raw": "ret void"}]},
    ]}], "declarations": [{"name": "malloc", "return_type": "ptr", "params": []}]},
    {"module_id": "m2", "target_triple": None, "functions": [], "declarations": []},
]


def packed(v, by_place=False):
    """The shortest form of every value; structs by name, or as arrays of their fields."""
    if v is None:
        return b"\xc0"
    if isinstance(v, str):
        raw = v.encode()
        return (bytes([0xA0 | len(raw)]) if len(raw) < 32 else b"\xd9" + bytes([len(raw)]) if len(raw) < 256 else b"\xda" + struct.pack(">H", len(raw))) + raw
    if isinstance(v, list):
        return (bytes([0x90 | len(v)]) if len(v) < 16 else b"\xdc" + struct.pack(">H", len(v))) + b"".join(packed(x, by_place) for x in v)
    if by_place:
        return packed(list(v.values()), True)
    return bytes([0x80 | len(v)]) + b"".join(packed(k) + packed(x) for k, x in v.items())


@pytest.mark.parametrize("by_place", [False, True])
def test_same_tables_as_json(spark, by_place):
    folder, other = tempfile.mkdtemp(prefix="spark-msgpack-"), tempfile.mkdtemp(prefix="spark-json-")
    with open(f"{folder}/a.mp", "wb") as f:
        f.write(packed(MODULES[0], by_place) + packed(MODULES[1], by_place))
    with open(f"{folder}/b.mp", "wb") as f:
        f.write(packed(MODULES[0] | {"module_id": "m3"}, by_place))
    with open(f"{folder}/_SUCCESS", "wb"):
        pass
    for i, m in enumerate([*MODULES, MODULES[0] | {"module_id": "m3"}]):
        with open(f"{other}/{i}.json", "w") as f:
            json.dump(m, f)
    got, want = msgpack.read(spark, folder), ir.read_json(spark, other)
    for name in want:
        assert sorted(map(repr, got[name].collect())) == sorted(map(repr, want[name].collect())), name


def test_every_format():
    raw = b"\x07\xff\xc2\xc3\xcc\xff\xcd\x01\x00\xd0\x80\xd3" + struct.pack(">q", -5) + b"\xcb" + struct.pack(">d", 0.5) + b"\xc4\x02ab\xd4\x01x\xc7\x02\x05yz\xdd\x00\x00\x00\x01\xc0\xde\x00\x01\xa1k\x01"
    assert list(msgpack.objects(io.BytesIO(raw))) == [7, -1, False, True, 255, 256, -128, -5, 0.5, b"ab", b"x", b"yz", [None], {"k": 1}]
    for bad in (b"\xc1", b"\x91" * 100 + b"\x01"):
        with pytest.raises(ValueError, match="MessagePack"):
            list(msgpack.objects(io.BytesIO(bad)))


def test_truncated_input_raises(spark):
    whole = packed(MODULES[0])
    for cut in (1, 5, len(whole) // 2, len(whole) - 1):
        with pytest.raises(ValueError, match="truncated"):
            list(msgpack.objects(io.BytesIO(whole[:cut])))
    folder = tempfile.mkdtemp(prefix="spark-msgpack-")
    with open(f"{folder}/cut.mp", "wb") as f:
        f.write(whole[:-3])
    with pytest.raises(Exception, match="truncated"):
        msgpack.read(spark, folder)["functions"].collect()
