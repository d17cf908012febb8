"""Licence scan: texts, brought to a canonical form, are looked up among known licence digests.

Whole texts by :func:`matched`; licences and notices that are some lines of a text by :func:`noticed`.
DataFrame functions only. The canonical form is free of case, punctuation, spacing, copyright lines and
of spellings that count as the same; its SHA-256 is joined with the digests of the known texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Spellings that mean the same in licence texts, as (found, canonical).
SPELLINGS = (
    ("acknowledgement", "acknowledgment"), ("analogue", "analog"), ("analyse", "analyze"), ("artefact", "artifact"),
    ("authorisation", "authorization"), ("authorised", "authorized"), ("calibre", "caliber"), ("cancelled", "canceled"),
    ("catalogue", "catalog"), ("categorise", "categorize"), ("centre", "center"), ("customisation", "customization"),
    ("emphasised", "emphasized"), ("favour", "favor"), ("favourite", "favorite"), ("fulfil", "fulfill"),
    ("fulfilment", "fulfillment"), ("https", "http"), ("initialise", "initialize"), ("judgement", "judgment"),
    ("labelling", "labeling"), ("labour", "labor"), ("licence", "license"), ("licenced", "licensed"),
    ("licences", "licenses"), ("licencing", "licensing"), ("maximise", "maximize"), ("modelled", "modeled"),
    ("modelling", "modeling"), ("noncommercial", "non commercial"), ("offence", "offense"), ("optimise", "optimize"),
    ("organisation", "organization"), ("organise", "organize"), ("practise", "practice"),
    ("programme", "program"), ("realise", "realize"), ("recognise", "recognize"), ("signalling", "signaling"),
    ("sublicence", "sublicense"), ("utilisation", "utilization"), ("whilst", "while"), ("wilful", "willful"),
)

_MIT_GRANT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"""
_MIT_WARRANTY = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC_GRANT = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"""
_ISC_WARRANTY = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_THREE = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""
_BSD_WARRANTY = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""

#: Texts of known licences and licence notices, as (identifier, text).
KNOWN = (
    ("MIT", f"MIT License\n\n{_MIT_GRANT}, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\n{_MIT_WARRANTY}"),
    ("MIT", f"{_MIT_GRANT}, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\n{_MIT_WARRANTY}"),
    ("MIT-0", f"MIT No Attribution\n\n{_MIT_GRANT}.\n\n{_MIT_WARRANTY}"),
    ("ISC", f"ISC License\n\n{_ISC_GRANT}, provided that the above copyright notice and this permission notice appear in all copies.\n\n{_ISC_WARRANTY}"),
    ("ISC", f"{_ISC_GRANT}, provided that the above copyright notice and this permission notice appear in all copies.\n\n{_ISC_WARRANTY}"),
    ("0BSD", f"{_ISC_GRANT}.\n\n{_ISC_WARRANTY}"),
    ("BSD-2-Clause", f"{_BSD_HEAD}\n{_BSD_WARRANTY}"),
    ("BSD-2-Clause", f"BSD 2-Clause License\n{_BSD_HEAD}\n{_BSD_WARRANTY}"),
    ("BSD-3-Clause", f"{_BSD_HEAD}\n{_BSD_THREE}\n{_BSD_WARRANTY}"),
    ("BSD-3-Clause", f"BSD 3-Clause License\n{_BSD_HEAD}\n{_BSD_THREE}\n{_BSD_WARRANTY}"),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.\n\nPermission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:\n\n1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.\n2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.\n3. This notice may not be removed or altered from any source distribution."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at\n\nhttp://www.apache.org/licenses/LICENSE-2.0\n\nUnless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "Released under the MIT License."),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("WTFPL", "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE\nVersion 2, December 2004\n\nEveryone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed.\n\nDO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE\nTERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION\n\n0. You just DO WHAT THE FUCK YOU WANT TO."),
)

#: Whole licences too long to list, as (identifier, words and SHA-256 of the canonical form), taken from
#: Debian's /usr/share/common-licenses.
WHOLE = (
    ("Apache-2.0", 1608, "95f35d79ea3bab75c250549d6a03cef242e0547d78c99e26fcede49936fb0184"),
    ("Artistic-1.0-Perl", 983, "08f1dc258c8f9e175155356aa1dd0dead8cfdec586bc1bb4c8b1452699a91702"),
    ("CC0-1.0", 1088, "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f"),
    ("GFDL-1.2-only", 3315, "94541e73869af10ab6bd68a29575eede324e54e7d5237e7386d12444f593af60"),
    ("GFDL-1.3-only", 3732, "a92fdbaeafedd9cbeb812ebbded06ee07e3b1427c81cfc333e682109c594d826"),
    ("GPL-1.0-only", 2068, "ec8a6b7d70e9f225b63d3962ed5b4721373f5535d7b967a06722b0d621f6892a"),
    ("GPL-2.0-only", 2976, "331b500eb3c5ee796906547305df82fff4a35b3aa03c1d3ea84d32078292b2e6"),
    ("GPL-3.0-only", 5684, "eaab5d82fdcca441d83a1913bbf07e4de3a739e190578c0bffde24f84e93bb2a"),
    ("LGPL-2.0-only", 4200, "61af4dcea4e412e8ccfb8877fd2762bd6d962f8d42a9fa2c06cf7b4613f2c908"),
    ("LGPL-2.1-only", 4401, "4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891"),
    ("LGPL-3.0-only", 1231, "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("MPL-1.1", 3789, "a1b36de49a400e3d3385d5987188db954a084f9876243aa7207cd91de3f24a7b"),
    ("MPL-2.0", 2426, "f82071285728ca3ec7685ee9bc4acdae0b8267142a4d20b8f1805eabedb4a98a"),
)

#: A line that names a holder, not terms: copyright with (c), the sign or a year, or the reservation alone, after
#: comment marks or none. Wrapped terms may begin a line with 'copyright notice' or 'copyright holder'.
_SIGN, _YEAR = r"(?:\(c\)|©|&copy;)", r"(?:[0-9]{4}|[<\[{(]year[>\]})])"
COPYRIGHT_LINE = (
    r"^[ \t]*(?:(?:[#*;%!|>\"'-]+|//+[*!]?|/\*+|<!--|\(\*)[ \t]*)?"
    rf"(?:copyright[ \t:]*(?:{_SIGN}|{_YEAR})[^\n]*|{_SIGN}[ \t]*(?:copyright\b|{_YEAR})[^\n]*|(?:©|&copy;)[^\n]*|all rights reserved[.!]?[ \t\r]*$)"
)


def canonical_words(text: Column) -> Column:
    """The canonical form as an array of words; a null text has none."""
    plain = F.regexp_replace(F.coalesce(text, F.lit("")), f"(?imd){COPYRIGHT_LINE}", " ")
    words = F.split(F.trim(F.regexp_replace(F.lower(plain), r"[^\p{L}\p{N}]+", " ")), " ")
    same = F.create_map(*[F.lit(x) for pair in SPELLINGS for x in pair])
    return F.transform(F.filter(words, lambda w: w != ""), lambda w: F.coalesce(F.try_element_at(same, w), w))


def digest(text: Column) -> Column:
    return F.sha2(F.concat_ws(" ", canonical_words(text)), 256)


def known_licenses(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(KNOWN, "license_id string, text string")


def matched(docs: DataFrame, licenses: DataFrame | None = None) -> DataFrame:
    """``doc_id, n_words, digest, license_id`` of each row of ``docs`` (doc_id, text).

    digest is the SHA-256 of the whole text's canonical form, license_id the identifier of the known text
    (of ``licenses``: license_id, text) with that form, the smallest of several, or null. A null text is
    an empty one; a form without words matches nothing, nor does a licence without identifier. Repeated
    rows give repeated results; other columns are ignored. The known texts are joined by their digest,
    by whichever hash join their size allows.
    """
    licenses = known_licenses(docs.sparkSession) if licenses is None else licenses
    known = licenses.filter("license_id is not null").select("license_id", canonical_words(F.col("text")).alias("w")).filter("size(w) > 0")
    known = known.groupBy(F.sha2(F.concat_ws(" ", "w"), 256).alias("digest")).agg(F.min("license_id").alias("license_id"))
    own = docs.select("doc_id", canonical_words(F.col("text")).alias("w"))
    own = own.select("doc_id", F.size("w").cast("long").alias("n_words"), F.sha2(F.concat_ws(" ", "w"), 256).alias("digest"))
    return own.join(known, "digest", "left").select("doc_id", "n_words", "digest", "license_id")


def _let(value: Column, f) -> Column:
    """``f(value)`` with ``value`` computed once: the optimizer would repeat it inside a lambda."""
    return F.transform(F.array(value), f)[0]


def _lined_words(text: Column) -> Column:
    """The canonical form as an array of words, with a line feed between lines."""
    plain = F.regexp_replace(F.coalesce(text, F.lit("")), f"(?imd){COPYRIGHT_LINE}", " ")
    plain = F.regexp_replace(F.regexp_replace(plain, r"\r\n?", "\n"), r"\n", " \n ")
    words = F.split(F.trim(F.regexp_replace(F.lower(plain), r"[^\p{L}\p{N}\n]+", " ")), " ")
    same = F.create_map(*[F.lit(x) for pair in SPELLINGS for x in pair])
    mapped = F.transform(F.filter(words, lambda w: w != ""), lambda w: F.coalesce(F.try_element_at(same, w), w))
    return F.filter(F.split(F.concat_ws(" ", mapped), " "), lambda w: w != "")  # a spelling may be two words


def known_digests(licenses: DataFrame) -> DataFrame:
    """``n, digest, license_id`` of known texts: words and SHA-256 of their canonical form, each once."""
    words = F.filter(_lined_words(F.col("text")), lambda w: w != "\n")
    known = licenses.filter("license_id is not null").select("license_id", words.alias("w")).filter("size(w) > 0")
    return known.groupBy(F.size("w").alias("n"), F.sha2(F.concat_ws(" ", "w"), 256).alias("digest")).agg(F.min("license_id").alias("license_id"))


def noticed(docs: DataFrame, licenses: DataFrame | None = None) -> DataFrame:
    """``doc_id, start_word, n_words, digest, license_id`` of each run of whole lines that is a known text.

    A run is any number of consecutive lines, so wrapping, blank lines and text around it make no difference;
    start_word counts the canonical words before it. Only runs with as many words as a known text have a
    digest taken. All matches come out, one in another too (a licence without its title in one with it).
    Known are ``licenses`` (license_id, text), or ``KNOWN`` and the whole licences of ``WHOLE``. A null text has
    no lines; repeated rows give repeated results; other columns are ignored.
    """
    spark = docs.sparkSession
    if licenses is None:
        known = known_digests(known_licenses(spark)).unionByName(spark.createDataFrame(WHOLE, "license_id string, n int, digest string"))
    else:
        known = known_digests(licenses)
    sizes = known.agg(F.collect_set("n").alias("sizes"))

    def runs(tokens: Column) -> Column:
        feeds = F.filter(F.transform(tokens, lambda t, i: F.when(t == "\n", i)), lambda i: i.isNotNull())
        bounds = F.array_distinct(F.concat(F.array(F.lit(0)), F.transform(feeds, lambda i, k: i - k), F.array(F.size(tokens) - F.size(feeds))))
        words = F.filter(tokens, lambda t: t != "\n")

        def of(b: Column, w: Column) -> Column:
            starts = F.transform("sizes", lambda n: F.transform(F.array_intersect(b, F.transform(b, lambda x: x - n)), lambda x: F.struct(x.alias("start"), n.alias("n"))))
            return F.transform(F.flatten(starts), lambda r: F.struct(r["start"].alias("start_word"), r["n"].alias("n"), F.sha2(F.concat_ws(" ", F.slice(w, r["start"] + 1, r["n"])), 256).alias("digest")))

        return _let(F.struct(bounds.alias("b"), words.alias("w")), lambda x: of(x["b"], x["w"]))

    found = docs.select("doc_id", "text").crossJoin(F.broadcast(sizes)).select("doc_id", F.explode(_let(_lined_words(F.col("text")), runs)).alias("r"))
    found = found.select("doc_id", F.col("r.start_word").cast("long").alias("start_word"), F.col("r.n").alias("n"), F.col("r.digest").alias("digest"))
    return found.join(known, ["n", "digest"]).select("doc_id", "start_word", F.col("n").cast("long").alias("n_words"), "digest", "license_id")
