"""Licence texts and notices that the scanner (operator 4) knows."""

from __future__ import annotations

# The wording of licences. The copyright line that precedes them isn't part of them.
_GRANT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"
_AS_IS = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_REDISTRIBUTION = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_ADVERTISING = "All advertising materials mentioning features or use of this software must display the following acknowledgement: This product includes software developed by the organization."
_ENDORSE = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_HOLDERS = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_ANY_PURPOSE = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_AUTHOR = "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
_APACHE = "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."
_ZLIB = "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."
_BOOST = "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor."
_UNLICENSE = "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law."

# Fixed values: (licence, text, words that its passage must have).
FULL: list[tuple[str, str, str]] = [
    ("MIT", f"{_GRANT}, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. {_AS_IS}", "substantial portions"),
    ("MIT-0", f"{_GRANT}. {_AS_IS}", ""),
    ("BSD-2-Clause", f"{_REDISTRIBUTION} {_HOLDERS}", ""),
    ("BSD-3-Clause", f"{_REDISTRIBUTION} 3. {_ENDORSE} {_HOLDERS}", "neither endorse promote"),
    ("BSD-4-Clause", f"{_REDISTRIBUTION} 3. {_ADVERTISING} 4. {_ENDORSE} {_HOLDERS}", "advertising acknowledgement endorse promote"),
    ("ISC", f"{_ANY_PURPOSE}, provided that the above copyright notice and this permission notice appear in all copies. {_AUTHOR}", "provided appear"),
    ("0BSD", f"{_ANY_PURPOSE}. {_AUTHOR}", ""),
    ("Zlib", _ZLIB, "misrepresented altered"),
    ("BSL-1.0", _BOOST, "machine executable"),
    ("Unlicense", _UNLICENSE, "unencumbered"),
    ("Apache-2.0", f"Licensed under the Apache License, Version 2.0 (the \"License\"); {_APACHE}", "apache 2 0"),
]

_CC = {"": "", "-SA": "-ShareAlike", "-ND": "-NoDerivatives", "-NC": "-NonCommercial", "-NC-SA": "-NonCommercial-ShareAlike", "-NC-ND": "-NonCommercial-NoDerivatives"}
_GNU = {"GPL-2.0": ("General", "2"), "GPL-3.0": ("General", "3"), "LGPL-2.1": ("Lesser General", "2.1"), "LGPL-3.0": ("Lesser General", "3"), "AGPL-3.0": ("Affero General", "3")}


def notices() -> list[tuple[str, str]]:
    """(licence, sentence) by which works name their licence; every word of TELLING in it must be there."""
    found = [("MIT", "Released under the MIT License."), ("MIT", "Licensed under the MIT License.")]
    found += [("Apache-2.0", "Licensed under the Apache License, Version 2.0.")]
    found += [("BSD-2-Clause", "Licensed under the BSD 2-Clause License."), ("BSD-3-Clause", "Licensed under the BSD 3-Clause License.")]
    found += [("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.")]
    found += [("EPL-2.0", "This program is made available under the terms of the Eclipse Public License, Version 2.0.")]
    found += [("Artistic-2.0", "Licensed under the Artistic License, Version 2.0.")]
    found += [("CC0-1.0", "Licensed under CC0 1.0."), ("CC0-1.0", "This work is dedicated to the public domain under CC0 1.0 Universal.")]
    for version, scope in (("3.0", "Unported"), ("4.0", "International")):
        for short, long in _CC.items():
            found.append((f"CC-BY{short}-{version}", f"Licensed under CC BY{short} {version}."))
            found.append((f"CC-BY{short}-{version}", f"This work is licensed under a Creative Commons Attribution{long} {version} {scope} License."))
    for name, (kind, version) in _GNU.items():
        found.append((name, f"This work is licensed under the GNU {kind} Public License, version {version}."))
        found.append((name, f"under the terms of the GNU {kind} Public License as published by the Free Software Foundation; either version {version} of the License"))
    return found


# Words that tell licences apart. A notice must have its own and no others among them.
TELLING = frozenset(
    "mit apache bsd clause mozilla eclipse artistic cc0 cc by nc sa nd attribution noncommercial sharealike noderivatives noderivs"
    " gnu general lesser library affero public creative commons international unported universal isc zlib boost open font sil python"
    " microsoft reciprocal cddl common cern european union academic educational affero european beer wtfpl artistic perl ruby php x11 mulan"
    " 0 1 2 3 4 5".split()
)
# Words too frequent in any text to point to a licence.
FREQUENT = frozenset("a all an and any are as at be but by for from in is it its may no not of on or other our such that the their this to use with without you".split())
