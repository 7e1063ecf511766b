"""License wording as template markup. The wording is that of the public license texts and notices.

`<<opt>> ... <</opt>>` may be absent; `<<var:N>>` stands for up to N arbitrary words (names of holders). Everything else is mandatory.
"""

from __future__ import annotations

MIT = """
Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the
"Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish,
distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the
following conditions: The above copyright notice and this permission notice <<opt>>(including the next paragraph)<</opt>> shall be included
in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED,
INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL
<<var:10>> BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR
IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.
"""

_BSD_CONDITIONS = """
Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are
met: <<opt>>1.<</opt>> Redistributions of source code must retain the above copyright notice, this list of conditions and the following
disclaimer. <<opt>>2.<</opt>> Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the
following disclaimer in the documentation and/or other materials provided with the distribution.
"""
_BSD_NAMES = """
<<opt>>3.<</opt>> Neither the name of <<var:12>> nor the names of its contributors may be used to endorse or promote products derived from
this software without specific prior written permission.
"""
_BSD_DISCLAIMER = """
THIS SOFTWARE IS PROVIDED BY <<var:10>> "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES
OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL <<var:10>> BE LIABLE FOR ANY DIRECT, INDIRECT,
INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF
USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT
(INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.
"""

ISC = """
Permission to use, copy, modify, and<<opt>>/or<</opt>> distribute this software for any purpose with or without fee is hereby granted,
provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND <<var:8>>
DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL
<<var:8>> BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR
PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF
THIS SOFTWARE.
"""

APACHE_NOTICE = """
Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may
obtain a copy of the License at http<<opt>>s<</opt>>://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in
writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either
express or implied. See the License for the specific language governing permissions and limitations under the License.
"""

GPL_NOTICE = """
This <<opt>>program<</opt>> <<opt>>file<</opt>> is free software<<opt>>:<</opt>> you can redistribute it and/or modify it under the terms of
the GNU General Public License as published by the Free Software Foundation, either version <<var:1>> of the License, or (at your option) any
later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.
"""

MPL_NOTICE = """
This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file,
You can obtain one at http<<opt>>s<</opt>>://mozilla.org/MPL/2.0
"""

#: One-sentence grants that name a license.
GRANTS = {
    "apache-2.0": "licensed under the apache license version 2.0",
    "mit": "<<opt>>released<</opt>> <<opt>>licensed<</opt>> under the <<opt>>terms of the<</opt>> mit license",
    "cc-by-4.0": "licensed under <<opt>>a<</opt>> <<opt>>the<</opt>> cc by <<opt>>international<</opt>> 4.0",
    "cc-by-nc-4.0": "licensed under <<opt>>a<</opt>> <<opt>>the<</opt>> cc by nc 4.0 <<opt>>international<</opt>>",
    "cc-by-sa-4.0": "licensed under <<opt>>a<</opt>> <<opt>>the<</opt>> cc by sa 4.0 <<opt>>international<</opt>>",
    "cc-by-nc-sa-4.0": "licensed under <<opt>>a<</opt>> <<opt>>the<</opt>> cc by nc sa 4.0 <<opt>>international<</opt>>",
    "cc-long": "licensed under a creative commons attribution <<var:4>> 4.0 international license",
    "gpl-3.0": "licensed under the gnu general public license version 3",
    "gpl-2.0": "licensed under the gnu general public license version 2",
    "notice-reserved": "copyright <<opt>>c<</opt>> <<var:8>> all rights reserved",
}

#: Identifiers behind `SPDX-License-Identifier:`.
SPDX = ("MIT", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "ISC", "MPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "LGPL-2.1-only", "LGPL-3.0-only", "AGPL-3.0-only", "CC0-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "Unlicense")

TEMPLATES = {
    **GRANTS,
    "mit-text": MIT,
    "mit-title": "the mit license <<opt>>mit<</opt>> copyright",
    "bsd-2-text": _BSD_CONDITIONS + _BSD_DISCLAIMER,
    "bsd-3-text": _BSD_CONDITIONS + _BSD_NAMES + _BSD_DISCLAIMER,
    "isc-text": ISC,
    "apache-2.0-notice": APACHE_NOTICE,
    "gpl-notice": GPL_NOTICE,
    "mpl-2.0-notice": MPL_NOTICE,
    **{f"spdx-{x.lower()}": f"spdx license identifier {x}" for x in SPDX},
}
