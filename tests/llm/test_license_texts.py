"""Licenses that are texts: all mandatory wording counts, optional and replaceable wording doesn't."""

import pytest

from rankmill.llm import license_scan as lic

from tests.llm.common import frame, prose

AS_IS = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS
IN THE SOFTWARE."""
MIT = f"""Copyright (c) 2021 Jane Doe

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to
deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or
sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

{AS_IS}"""
BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
%sTHIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE
LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS
OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT
LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH
DAMAGE."""
NAMES = """%d. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software
   without specific prior written permission.

"""
ADVERTISING = "3. All advertising materials mentioning features or use of this software must display the following acknowledgement: This product includes software developed by Example Inc.\n"
ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY
AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM
LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR
PERFORMANCE OF THIS SOFTWARE."""
UNLICENSE = f"""This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any
purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the
public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this
dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

{AS_IS.replace('OR COPYRIGHT HOLDERS ', '')}"""
WHOLE = {"mit": MIT, "bsd-2": BSD % "", "bsd-3": BSD % (NAMES % 3), "bsd-4": BSD % (ADVERTISING + NAMES % 4), "isc": ISC, "unlicense": UNLICENSE}


def labels(spark, own):
    return {r.doc_id: (r.labels, r.score) for r in lic.license_scan(frame(spark, own)).collect()}


def test_whole_texts_have_their_label_alone(spark):
    own = {i: prose(i, 20) + "\n" + t + "\n" + prose(50 + i, 20) for i, t in enumerate(WHOLE.values())}
    own[20] = MIT.replace("NONINFRINGEMENT", "NON-INFRINGEMENT").replace("THE AUTHORS OR COPYRIGHT HOLDERS", "EXAMPLE INC.")
    own[21] = (BSD % (NAMES % 3)).replace("the copyright holder nor", "Example Inc. nor").replace("3. ", "* ")
    own[22] = ISC.replace("and/or", "and").replace("THE AUTHOR", "ISC")
    want = {i: (name, 1.0) for i, name in enumerate(WHOLE)} | {20: ("mit", 1.0), 21: ("bsd-3", 1.0), 22: ("isc", 1.0)}
    assert labels(spark, own) == want


@pytest.mark.parametrize(
    "change",
    [
        ("mit", "subject to the following conditions:", "subject to the following conditions: the Software shall be used for good, not evil."), ("mit", "shall be included in all copies", "may be left out of copies"), ("mit", "WITHOUT WARRANTY", "WITH A WARRANTY"),
        ("bsd-2", "must retain", "needn't retain"), ("bsd-2", "EVEN IF ADVISED OF THE POSSIBILITY OF SUCH\nDAMAGE.", ""), ("bsd-3", "without specific prior written permission", "without a fee"),
        ("isc", "DISCLAIMS ALL", "GIVES ALL"), ("unlicense", "for any\npurpose", "for a private\npurpose"),
    ],
)
def test_a_changed_condition_is_refused(spark, change):
    name, old, new = change
    assert old in WHOLE[name]
    assert labels(spark, {0: WHOLE[name].replace(old, new)}) == {0: ("", 0.0)}


def test_an_opening_sentence_is_no_license(spark):
    own = {0: MIT[: MIT.index(", including")], 1: (BSD % "")[: BSD.index(":")], 2: ISC[: ISC.index("\n\n")], 3: UNLICENSE[: UNLICENSE.index("\n")]}
    assert set(labels(spark, own).values()) == {("", 0.0)}
