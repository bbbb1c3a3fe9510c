"""Small awkward tables and plain versions of the contracts."""

import hashlib
import random
import re
import zlib

WS = " \t\n\x0b\x0c\r"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, id long, size long"


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def low(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def sha(t):
    return hashlib.sha256(t.encode() if isinstance(t, str) else t).hexdigest()


def rows(n=120, seed=1):
    """Copies, near copies, shared passages, repeated lines, nulls, empty and long texts, ties; extra columns with names in use inside."""
    r = random.Random(seed)
    vocab = ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 8))) for _ in range(3000)]
    text = lambda k: " ".join(r.choice(vocab) for _ in range(k))
    passage, line = text(70), "A shared line that is longer than forty characters, it is"
    base = [w for w in text(200).split()]
    out = []
    for i in range(n):
        t = text(r.randint(1, 150))
        if i % 10 == 1:
            t = t + " " + passage + "\t" + text(5)
        if i % 10 == 2:
            near = list(base)
            for _ in range(r.randint(0, 8)):
                near[r.randrange(len(near))] = r.choice(vocab)
            t = " ".join(near)
        if i % 10 == 3:
            t = t + "\n  " + line.upper() * (i % 20 == 3) + line * (i % 20 != 3) + " \n" + text(4)
        if i % 10 == 4:
            t = "exact copy of a text that is long enough for shingles of five words"
        if i % 10 == 5:
            t = (text(3) + " ") * 40
        if i % 30 == 6:
            t = "x under the MIT license, Apache License, Version 2.0 and CC-BY-NC 4.0; SPDX-License-Identifier: GPL-3.0\nunder the mit license"
        out.append((i * 3 % 1000, t, r.choice(["en", "fr", None]), r.choice(["a", "b", "c", None]), len(t), "k", i, i))
    out += [(5000, None, "en", "a", None, None, None, None), (5001, "", None, "b", 0, None, None, None), (None, "no id here " * 3, "en", None, 5, None, None, None), (5002, " \n\t\n ", "en", "a", 5, "k", 1, 1)]
    out += [(5003, "naïve café 日本語 ١٢٣   x y !!! 'tis it's\r\n  end  ", "fr", "b", 40, "k", 1, 1), (5004, "word " * 20000, "en", "c", 100000, "k", 1, 1), out[7], out[7]]
    return out


def table(spark, data=None):
    return spark.createDataFrame(rows() if data is None else data, SCHEMA)


def fold(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 3
