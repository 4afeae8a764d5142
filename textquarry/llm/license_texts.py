"""Wordings of licenses that texts are compared with: data only."""

from __future__ import annotations

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""

_BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
_BSD_THIRD = """
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
"""
_BSD_TAIL = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""

_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""

_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""


def _gpl(name: str, version: str, what: str = "program") -> str:
    return (
        f"This {what} is free software; you can redistribute it and/or modify it under the terms of the {name} as published by the Free Software Foundation; either version {version} of the License, or (at your option) any later version. "
        f"This {what} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {name} for more details."
    )


_UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."""

_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution."""

_BSL = """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:"""

_MPL = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."""

_EPL = """This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"""

GNU = "GNU General Public License"
#: Of each wording: license, text, words that must be there exactly.
TEMPLATES: list[tuple[str, str, str]] = [
    ("MIT", "Released under the MIT License.", "mit"),
    ("MIT", "Licensed under the MIT License.", "mit"),
    ("MIT", "This project is licensed under the terms of the MIT license.", "mit"),
    ("MIT", _MIT.split(", including")[0], "permission granted"),
    ("MIT", _MIT, "permission granted sublicense"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0.", "apache 2 0"),
    ("Apache-2.0", "Released under the Apache License 2.0.", "apache 2 0"),
    ("Apache-2.0", _APACHE, "apache 2 0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3.", "gnu general public 3"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License version 3", "gnu general public 3"),
    ("GPL-3.0", _gpl(GNU, "3"), "gnu general public 3 redistribute"),
    ("GPL-2.0", "This program is licensed under the GNU General Public License, version 2.", "gnu general public 2"),
    ("GPL-2.0", _gpl(GNU, "2"), "gnu general public 2 redistribute"),
    ("LGPL-2.1", _gpl("GNU Lesser General Public License", "2.1", "library"), "gnu lesser 2 1 redistribute"),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3.", "gnu lesser public 3"),
    ("LGPL-3.0", _gpl("GNU Lesser General Public License", "3", "library"), "gnu lesser 3 redistribute"),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3.", "gnu affero public 3"),
    ("AGPL-3.0", _gpl("GNU Affero General Public License", "3"), "gnu affero 3 redistribute"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "mozilla 2 0"),
    ("MPL-2.0", _MPL, "mozilla 2 0 obtain"),
    ("EPL-2.0", _EPL, "eclipse 2 0"),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License.", "bsd 3 clause"),
    ("BSD-3-Clause", _BSD_HEAD + _BSD_THIRD + _BSD_TAIL, "redistributions endorse promote"),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License.", "bsd 2 clause"),
    ("BSD-2-Clause", _BSD_HEAD + _BSD_TAIL, "redistributions reproduce disclaimed"),
    ("BSD", _BSD_HEAD.split("\n\n")[0], "redistribution permitted"),
    ("ISC", "Licensed under the ISC License.", "isc"),
    ("ISC", _ISC, "fee granted disclaims"),
    ("Zlib", _ZLIB, "misrepresented altered"),
    ("BSL-1.0", _BSL, "organization derivative granted"),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0.", "boost 1 0"),
    ("Unlicense", "This is free and unencumbered software released into the public domain.", "unencumbered public domain"),
    ("Unlicense", _UNLICENSE, "unencumbered public domain anyone"),
    ("CC0-1.0", "Licensed under CC0 1.0 Universal.", "cc0 1 0"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0.", "cc by 4 0"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0.", "cc by sa 4 0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0.", "cc by nc 4 0"),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0.", "cc by nd 4 0"),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0.", "cc by nc sa 4 0"),
    *[
        (f"CC-{code}-4.0", f"This work is licensed under a Creative Commons {name} 4.0 International License.", f"creative commons 4 0 {must}")
        for code, name, must in (
            ("BY", "Attribution", "attribution"),
            ("BY-SA", "Attribution-ShareAlike", "sharealike"),
            ("BY-NC", "Attribution-NonCommercial", "noncommercial"),
            ("BY-ND", "Attribution-NoDerivatives", "noderivatives"),
            ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike", "noncommercial sharealike"),
            ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives", "noncommercial noderivatives"),
        )
    ],
    ("proprietary", "All rights reserved.", "all rights reserved"),
]
