"""What public licences are called and how their texts and headers run."""

from __future__ import annotations

#: SPDX identifier: the names that statements use.
NAMES = {
    "0BSD": ["bsd zero clause license", "0bsd license"],
    "AGPL-3.0": ["gnu affero general public license version 3", "agpl 3.0", "agplv3"],
    "Apache-2.0": ["apache license version 2.0", "apache 2.0 license", "apache license 2.0"],
    "BSD-2-Clause": ["bsd 2 clause license", "simplified bsd license", "freebsd license"],
    "BSD-3-Clause": ["bsd 3 clause license", "modified bsd license", "new bsd license"],
    "BSL-1.0": ["boost software license version 1.0"],
    "CC-BY-4.0": ["creative commons attribution 4.0 international license", "cc by 4.0"],
    "CC-BY-NC-4.0": ["creative commons attribution noncommercial 4.0 international license", "cc by nc 4.0"],
    "CC-BY-ND-4.0": ["creative commons attribution noderivatives 4.0 international license", "cc by nd 4.0"],
    "CC-BY-SA-4.0": ["creative commons attribution sharealike 4.0 international license", "cc by sa 4.0"],
    "CC0-1.0": ["creative commons cc0 1.0 universal public domain dedication", "cc0 1.0"],
    "EPL-2.0": ["eclipse public license version 2.0", "eclipse public license 2.0"],
    "GPL-2.0": ["gnu general public license version 2", "gpl 2.0", "gplv2"],
    "GPL-3.0": ["gnu general public license version 3", "gpl 3.0", "gplv3"],
    "ISC": ["isc license"],
    "LGPL-2.1": ["gnu lesser general public license version 2.1", "lgpl 2.1"],
    "LGPL-3.0": ["gnu lesser general public license version 3", "lgpl 3.0"],
    "MIT": ["mit license", "expat license"],
    "MPL-2.0": ["mozilla public license version 2.0", "mozilla public license 2.0", "mpl 2.0"],
    "Unlicense": ["unlicense"],
    "Zlib": ["zlib license"],
}
#: How a statement speaks of a licence by its name.
FRAMES = (
    "{}", "licensed under the {}", "licensed under {}", "released under the {}", "released under {}", "this work is licensed under the {}", "this work is licensed under a {}",
    "this file is licensed under the terms of the {}", "distributed under the terms of the {}", "available under the {}", "see the license file for the {}", "this project is licensed under the {}",
)
_AS_IS = (
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"
    " in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with"
    " the software or the use or other dealings in the software"
)
_BSD = (
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above"
    " copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer"
    " in the documentation and or other materials provided with the distribution"
)
_BSD_END = (
    " this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness"
    " for a particular purpose are disclaimed in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but"
    " not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or"
    " tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"
)
_GPL = (
    "this program is free software you can redistribute it and or modify it under the terms of the {0} as published by the free software foundation {1} or at your option any later version this program"
    " is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the {0} for more details you"
    " should have received a copy of the {0} along with this program"
)
_MIT = (
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including"
    " without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to"
    " the following conditions"
)
_APACHE = (
    "licensed under the apache license version 2.0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license"
    " 2.0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or"
    " implied see the license for the specific language governing permissions and limitations under the license"
)
#: How the texts of the long licences open: their titles with their dates, and the first sentences that speak of them.
TITLES = [
    ("GPL-2.0", "gnu general public license version 2 june 1991"),
    ("GPL-3.0", "gnu general public license version 3 29 june 2007"),
    ("GPL-3.0", "the gnu general public license is a free copyleft license for software and other kinds of works"),
    ("AGPL-3.0", "gnu affero general public license version 3 19 november 2007"),
    ("AGPL-3.0", "the gnu affero general public license is a free copyleft license for software and other kinds of works specifically designed to ensure cooperation with the community in the case of network server software"),
    ("LGPL-2.1", "gnu lesser general public license version 2.1 february 1999"),
    ("LGPL-3.0", "gnu lesser general public license version 3 29 june 2007"),
    ("LGPL-3.0", "this version of the gnu lesser general public license incorporates the terms and conditions of version 3 of the gnu general public license supplemented by the additional permissions listed below"),
    ("Apache-2.0", "apache license version 2.0 january 2004 http www apache org licenses"),
    ("Apache-2.0", "license shall mean the terms and conditions for use reproduction and distribution as defined by sections 1 through 9 of this document"),
    ("MPL-2.0", "mozilla public license version 2.0 1 definitions"),
    ("EPL-2.0", "eclipse public license v 2.0"),
    ("EPL-2.0", "the accompanying program is provided under the terms of this eclipse public license agreement any use reproduction or distribution of the program constitutes recipient s acceptance of this agreement"),
    *[
        (key, f"by exercising the licensed rights defined below you accept and agree to be bound by the terms and conditions of this creative commons {name} 4.0 international public license public license")
        for key, name in (("CC-BY-4.0", "attribution"), ("CC-BY-SA-4.0", "attribution sharealike"), ("CC-BY-NC-4.0", "attribution noncommercial"), ("CC-BY-ND-4.0", "attribution noderivatives"))
    ],
]
#: Whole texts, standard headers and sentences that stand for a licence on their own, without the lines that name a holder.
TEXTS = [
    ("MIT", f"mit license {_MIT} the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software {_AS_IS}"),
    ("MIT", _MIT),
    (
        "ISC",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all"
        " copies the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall the"
        " author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other"
        " tortious action arising out of or in connection with the use or performance of this software",
    ),
    ("BSD-2-Clause", _BSD + _BSD_END),
    ("BSD-3-Clause", f"{_BSD} neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission{_BSD_END}"),
    (
        "Zlib",
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to"
        " anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions the origin of this software must not"
        " be misrepresented you must not claim that you wrote the original software altered source versions must be plainly marked as such and must not be misrepresented as being the original software this"
        " notice may not be removed or altered from any source distribution",
    ),
    (
        "Unlicense",
        "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled"
        " binary for any purpose commercial or non commercial and by any means",
    ),
    ("Apache-2.0", _APACHE),
    ("Apache-2.0", _APACHE[: _APACHE.index(" you may obtain")]),
    *[(key, _GPL.format(name, f"either version {version} of the license")) for key, name, version in (("GPL-2.0", "gnu general public license", "2"), ("GPL-3.0", "gnu general public license", "3"), ("LGPL-2.1", "gnu lesser general public license", "2.1"), ("LGPL-3.0", "gnu lesser general public license", "3"), ("AGPL-3.0", "gnu affero general public license", "3"))],
    *TITLES,
    ("MPL-2.0", "this source code form is subject to the terms of the mozilla public license v 2.0 if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2.0"),
    ("BSL-1.0", "distributed under the boost software license version 1.0 see accompanying file license 1.0 txt or copy at http www boost org license 1.0 txt"),
    ("CC0-1.0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    ("Proprietary", "all rights reserved"),
    ("Proprietary", "copyright all rights reserved"),
    ("Proprietary", "no part of this publication may be reproduced without prior written permission of the publisher"),
    ("Proprietary", "unauthorized copying of this file via any medium is strictly prohibited proprietary and confidential"),
]


def all_templates() -> list[tuple[str, str]]:
    """(identifier, text) of every template; the names times the frames, and the texts."""
    return [(key, frame.format(name)) for key, names in NAMES.items() for name in names for frame in FRAMES] + TEXTS
