"""Licence scan by canonical digests, in DataFrame functions only.

A text is brought to a canonical form (case, punctuation, copyright lines,
equivalent spellings) and its SHA-256 looked up among the digests of known
licence texts.  Whole documents are looked up, and each of their lines as a
text of its own, since short notices stand on one line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Runs of these become one space: ASCII other than letters and digits, and typographic punctuation.
PUNCTUATION = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F ©«»‐-―‘-‟•…]+"
#: A line that starts so, after spaces and comment marks, states a copyright and isn't part of the licence's text.  It needs
#: a sign, or a year: lines of a licence that happen to begin with the word, or with a clause (c), stay.
COPYRIGHT = ("^[ \\t\\x0B\\f\\r#*/;!-]*((?i:copyright)[ \\t:,]*((?i:\\(c\\))|©|(19|20)[0-9][0-9])|(?i:\\(c\\))[ \\t:,]*(19|20)[0-9][0-9]"
             "|\\(C\\) +[A-Z][a-z]|©|(?i:all rights reserved)[ \\t.\\r]*$)")

# Spellings that count as equal (the canonical one second), on the text without punctuation.
SPELLINGS = [("licence", "license"), ("licenced", "licensed"), ("sub license", "sublicense"), ("organisation", "organization"),
             ("favour", "favor"), ("honour", "honor"), ("acknowledgement", "acknowledgment"), ("judgement", "judgment"),
             ("merchantibility", "merchantability"), ("non commercial", "noncommercial"), ("non infringement", "noninfringement"),
             ("per cent", "percent"), ("copyright owner", "copyright holder"), ("https", "http"), ("cc by", "creative commons attribution"),
             ("fulfil ", "fulfill "), ("whilst", "while"), ("wilful", "willful")]

# Public licence texts and one-line notices, by identifier.
KNOWN: dict[str, list[str]] = {
    "MIT": ["""Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
            "Released under the MIT License.", "Licensed under the MIT License.", "This project is licensed under the MIT License.",
            "This software is released under the MIT License.", "SPDX-License-Identifier: MIT"],
    "ISC": ["""Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
            "Released under the ISC License.", "Licensed under the ISC License.", "SPDX-License-Identifier: ISC"],
    "0BSD": ["""Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
             "SPDX-License-Identifier: 0BSD"],
    "Zlib": ["""This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.""",
             "Released under the zlib License.", "SPDX-License-Identifier: Zlib"],
    "BSD-2-Clause": ["""Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
                     "SPDX-License-Identifier: BSD-2-Clause"],
    "BSD-3-Clause": ["""Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
                     "Released under the BSD 3-Clause License.", "SPDX-License-Identifier: BSD-3-Clause"],
    "Unlicense": ["""This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE. For more information, please refer to <https://unlicense.org>""",
                  "SPDX-License-Identifier: Unlicense"],
    "Apache-2.0": ["""Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
                   "Licensed under the Apache License, Version 2.0.", "Released under the Apache License 2.0.", "SPDX-License-Identifier: Apache-2.0"],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "Licensed under the GNU General Public License, version 3.",
                "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
                "SPDX-License-Identifier: GPL-3.0-only", "SPDX-License-Identifier: GPL-3.0-or-later"],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2.", "SPDX-License-Identifier: GPL-2.0-only"],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under CC BY-NC 4.0."],
    "CC0-1.0": ["Released under CC0 1.0.", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."],
}


def _spelled(text: Column) -> Column:
    for other, usual in SPELLINGS:
        text = F.replace(text, F.lit(other), F.lit(usual))
    return text


def with_canonical(df: DataFrame, text_col: str) -> DataFrame:
    """Adds ``lines`` (canonical lines that hold words, copyright lines left out) and ``canonical`` (the whole text).

    Equivalent spellings are replaced in the whole text after its line ends became spaces, so that a wrapped one counts too."""
    kept = F.filter(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n"), lambda x: ~x.rlike(COPYRIGHT))
    low = F.translate(F.array_join(kept, "\n"), UPPER, LOWER)
    # one pass over the whole text; a line end stays one through it
    plain = F.regexp_replace(F.regexp_replace(low, PUNCTUATION.replace("\\x00-\\x2F", "\\x00-\\x09\\x0B-\\x2F"), " "), " *\n[ \n]*", "\n")
    plain = F.trim(F.regexp_replace(plain, "^[ \n]+|[ \n]+$", ""))
    return df.withColumn("plain", plain).withColumn("lines", F.filter(F.split(_spelled(F.col("plain")), "\n"), lambda x: x != "")).withColumn(
        "canonical", _spelled(F.replace("plain", F.lit("\n"), F.lit(" ")))).drop("plain")


def known_digests(spark: SparkSession, known: dict[str, list[str]] | None = None) -> DataFrame:
    """(digest, license, size): the canonical digests of the known texts and their lengths."""
    rows = [(k, t) for k, texts in (known or KNOWN).items() for t in texts]
    texts = with_canonical(spark.createDataFrame(rows, "license string, text string"), "text")
    return texts.groupBy(F.sha2("canonical", 256).alias("digest")).agg(F.min("license").alias("license"),
                                                                           F.first(F.length("canonical")).alias("size"))


def scan_licenses(docs: DataFrame, known: dict[str, list[str]] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Known licences of every document: the whole text's, and those whose text or notice is one of its lines.

    Returns (doc_id, license, n_lines, licenses), one row per row of ``docs``:
    license is that of the whole text or null; n_lines the lines that are a
    known text; licenses the distinct identifiers found, sorted and joined by
    commas ("" if none).  Null, empty and punctuation-only texts have none;
    ids may be null or repeated; other columns are not looked at.  The known
    texts are a fixed list, so their digests are broadcast.
    """
    spark = docs.sparkSession
    known_df = known_digests(spark, known)
    sizes = [r["size"] for r in known_df.select("size").distinct().collect()]  # of the fixed list
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(F.col(text_col)).alias("th"))
    # one unit for the whole text, and one for each line as long as a known text (others can't be one)
    lines = F.filter("lines", lambda x: F.length(x).isin(sizes))
    units = with_canonical(docs, "text").select("doc_id", "th", F.posexplode(F.concat(F.array("canonical"), lines)).alias("i", "unit"))
    units = units.withColumn("digest", F.when(F.length("unit").isin(sizes), F.sha2("unit", 256)))
    found = units.join(F.broadcast(known_df.select("digest", "license")), "digest", "left").where("i = 0 or license is not null")
    whole = F.col("i") == 0
    per = found.groupBy("doc_id", "th").agg(
        F.count_if(whole).alias("rows"), F.max(F.when(whole, F.col("license"))).alias("license"), F.count_if(~whole).alias("n"),
        F.array_join(F.sort_array(F.collect_set("license")), ",").alias("licenses"))
    # equal rows were counted together
    return per.select("doc_id", "license", (F.col("n") / F.col("rows")).cast("long").alias("n_lines"), "licenses",
                      F.explode(F.array_repeat(F.lit(0), F.col("rows").cast("int"))).alias("row")).drop("row")
