import json
import struct

import numpy as np
import pytest

from hubwarden.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(cores=8, shuffle_partitions=4, memory="8g")
    session.sparkContext.setLogLevel("ERROR")
    yield session


def safetensors_bytes(tensors: dict) -> bytes:
    """Encode {key: (dtype name, array)} in the public safetensors layout."""
    header, body = {}, b""
    for key, (dtype, array) in tensors.items():
        raw = array.tobytes()
        header[key] = {"dtype": dtype, "shape": list(array.shape), "data_offsets": [len(body), len(body) + len(raw)]}
        body += raw
    head = json.dumps(header).encode()
    return struct.pack("<Q", len(head)) + head + body


def put(root, relpath, data):
    path = root / relpath
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(data if isinstance(data, bytes) else data.encode())
    return path


def f32(*values):
    return ("F32", np.array(values, dtype="<f4"))
