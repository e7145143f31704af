"""Known licences: whole texts shipped in ``known_licenses`` with their usual titles, and one-line notices.

A file's name up to '@' is the licence's SPDX id, without '-only' and '-or-later', which a text alone doesn't tell.
"""

from __future__ import annotations

import itertools
import re
from pathlib import Path

FOLDER = Path(__file__).with_name("known_licenses")
#: Usual titles of short licences, which stand above the text or not at all.
TITLES = {
    "MIT": ["MIT License", "The MIT License", "The MIT License (MIT)", "MIT License (MIT)", "MIT", "Expat License", "MIT/Expat License", "License: MIT"],
    "MIT-0": ["MIT No Attribution", "MIT No Attribution License", "MIT-0", "MIT-0 License"],
    "ISC": ["ISC License", "The ISC License", "ISC License (ISC)", "The ISC License (ISC)", "ISC", "ISC License (ISCL)"],
    "0BSD": ["BSD Zero Clause License", "Zero-Clause BSD", "0BSD", "BSD-0-Clause"],
    "BSD-2-Clause": ["BSD 2-Clause License", "The BSD 2-Clause License", "BSD-2-Clause", 'BSD 2-Clause "Simplified" License', "Simplified BSD License", "BSD License", "The BSD License", "FreeBSD License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "The BSD 3-Clause License", "BSD-3-Clause", 'BSD 3-Clause "New" or "Revised" License', "New BSD License", "Modified BSD License", "BSD License", "The BSD License", "3-Clause BSD License"],
    "Zlib": ["zlib License", "The zlib License", "zlib/libpng License", "The zlib/libpng License"],
    "Unlicense": ["The Unlicense", "Unlicense"],
    "BSL-1.0": [],
}
_RESERVED = {"MIT", "MIT-0", "ISC", "0BSD", "BSD-2-Clause", "BSD-3-Clause"}
_CREATIVE = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-NC": "Attribution-NonCommercial", "BY-ND": "Attribution-NoDerivatives", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}
#: Names that one-line notices use.
NAMES = {
    "MIT": ["MIT License", "MIT"], "ISC": ["ISC License", "ISC"], "0BSD": ["BSD Zero Clause License"], "BSD-2-Clause": ["BSD 2-Clause License", "BSD-2-Clause License", "Simplified BSD License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "BSD-3-Clause License", "New BSD License"], "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0", "Apache 2.0 License", "Apache-2.0 License"],
    "MPL-2.0": ["Mozilla Public License, Version 2.0", "Mozilla Public License 2.0", "Mozilla Public License, v. 2.0", "MPL 2.0"], "Unlicense": ["Unlicense"], "Zlib": ["zlib License"], "BSL-1.0": ["Boost Software License 1.0", "Boost Software License, Version 1.0"],
    "CC0-1.0": ["CC0 1.0", "CC0 1.0 Universal", "Creative Commons CC0 1.0 Universal"], "WTFPL": ["WTFPL"], "EPL-2.0": ["Eclipse Public License 2.0", "Eclipse Public License, Version 2.0"], "OFL-1.1": ["SIL Open Font License, Version 1.1", "SIL Open Font License 1.1"],
} | {
    f"{short}-{v}": [f"{name} v{v}", f"{name}, version {v}", f"{name} version {v}", f"{short} v{v}", f"{short}-{v}", *([f"{name} v{v[0]}", f"{name}, version {v[0]}", f"{name} version {v[0]}", f"{short} v{v[0]}", f"{short}v{v[0]}"] if v.endswith(".0") else [])]
    for short, name, versions in (("GPL", "GNU General Public License", ["2.0", "3.0"]), ("LGPL", "GNU Lesser General Public License", ["2.1", "3.0"]), ("AGPL", "GNU Affero General Public License", ["3.0"])) for v in versions
} | {
    f"CC-{k}-{v}": [f"CC {k} {v}", f"CC-{k}-{v}", f"Creative Commons {name} {v}", f"Creative Commons {name} {v} International License" if v == "4.0" else f"Creative Commons {name} {v} Unported License"]
    for k, name in _CREATIVE.items() for v in ("3.0", "4.0")
}
_SAID = ["{w} under {n}.", "{w} under the {n}.", "{w} under a {n}.", "{w} under the terms of the {n}."]
_SUBJECTS = ["", "This work is ", "This project is ", "This software is ", "This program is ", "This code is ", "This file is ", "This document is "]


def _bodies(name: str, text: str) -> list[str]:
    """A text, and its usual shorter and otherwise numbered forms."""
    out = [text]
    if name in TITLES and name.startswith("BSD-"):
        out.append(re.sub(r"(?m)^\s*\d\.", "", text))
    if name == "MIT":
        out.append(text.replace("this permission notice shall", "this permission notice (including the next paragraph) shall"))
    if name in ("ISC", "0BSD"):
        out.append(text.replace("and/or", "and"))
    if name == "CC-BY-SA-4.0" and (m := re.search(r"(?s)\n=+\n+(Creative Commons Attribution.*?)\n=+\n", text)):
        out += [m[1], text[: text.index("\n")] + "\n" + m[1]]
    if m := re.search(r"(?m)^\s*(END OF TERMS AND CONDITIONS)\s*$", text):
        out += [text[: m.start()], text[: m.end()]]
    elif m := re.search(r"(?m)^ADDENDUM: How to use", text):
        out.append(text[: m.start()])
    out += [t.replace("https://", "http://") for t in out] + [t.replace("http://", "https://") for t in out]
    return list(dict.fromkeys(out))


def texts(mit: str, isc: str) -> list[tuple[str, str]]:
    """(license, whole text) of every form of every shipped licence, and of those that follow from MIT's and ISC's."""
    first, _, last = mit.split("\n\n")
    found = [("MIT", mit), ("ISC", isc), ("MIT-0", first.replace(", subject to the following conditions:", ".") + "\n\n" + last), ("0BSD", isc.replace(", provided that the above copyright notice and this permission notice appear in all copies", ""))]
    found += [(p.stem.split("@")[0], p.read_text(encoding="utf-8")) for p in sorted(FOLDER.glob("*.txt"))]
    out = []
    for name, text in found:
        for body in _bodies(name, text):
            for title, reserved in itertools.product(["", *TITLES.get(name, [])], ["", "All rights reserved.\n"] if name in _RESERVED else [""]):
                out.append((name, f"{title}\n\n{reserved}{body}"))
    return out


def notices() -> list[tuple[str, str]]:
    """(license, line) of one-line notices."""
    out = [(name, f"{s}{said}".format(w="licensed", n=n)) for name, names in NAMES.items() for n in names for s in _SUBJECTS for said in _SAID]
    out += [(name, said.format(w=w, n=n)) for name, names in NAMES.items() for n in names for w in ("Released", "Distributed", "Available") for said in _SAID]
    out += [(name, f"SPDX-License-Identifier: {name}{end}") for name in {**NAMES, **TITLES} for end in (("", "-only", "-or-later", "+") if "GPL" in name else ("",))]
    out += [(name, f"License: {n}") for name, names in NAMES.items() for n in [name, *names]]
    return out
