"""Hand-written license rules over normalised words.

A line is: label, priority, confidence, keyword, regular expression.  The
expression sees lower-case words with one space between them, punctuation gone,
and has to begin and end at word bounds; it is tried only on texts that contain
the keyword.  Names (10) yield to notices (20 to 40), those to grants in full
(50 and up), where one lies inside the other.
"""

RULES = r"""
mit 60 0.99 mit | under the mit license
mit 55 0.95 mit | (?:released|licensed|distributed|available|provided|published) under (?:the )?(?:terms of the )?mit license
mit 50 0.9 mit | (?:license|licence)s? (?:is )?mit
mit 20 0.8 mit | (?:the )?mit licen[sc]e(?: expat)?
mit 50 0.95 spdx | spdx license identifier mit
mit 60 0.97 permission | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
mit 40 0.9 mit | mit style licen[sc]e
mit 40 0.9 opensource | opensource org licenses? mit
mit 20 0.8 expat | expat licen[sc]e
mit-0 50 0.95 mit | mit no attribution
mit-0 55 0.95 spdx | spdx license identifier mit 0
apache-2 60 0.99 apache | apache license version 2
apache-2 65 0.99 apache | licensed under the apache license version 2 0
apache-2 50 0.95 apache | apache (?:software )?licen[sc]e (?:v|version )?2(?: 0)?
apache-2 50 0.95 apache | apache 2(?: 0)? licen[sc]e
apache-2 50 0.95 spdx | spdx license identifier apache 2 0
apache-2 55 0.95 apache | (?:http|https) www apache org licenses license 2 0
apache-2 40 0.85 apache | under (?:the )?apache 2(?: 0)?
apache-2 55 0.9 apache | asl 2 0 apache
apache-1.1 50 0.95 apache | apache (?:software )?licen[sc]e (?:v|version )?1 1
apache-1.1 50 0.95 spdx | spdx license identifier apache 1 1
apache-1.0 50 0.95 apache | apache (?:software )?licen[sc]e (?:v|version )?1 0
apache 20 0.7 apache | apache (?:software )?licen[sc]e
gpl-3 60 0.99 general | gnu general public licen[sc]e (?:as published by the free software foundation )?(?:either )?(?:v|version )3
gpl-3 65 0.99 general | licensed under the gnu general public license version 3
gpl-3 50 0.95 gpl | gpl ?v?3(?: 0)?
gpl-3 50 0.95 gpl | (?:gnu )?gpl (?:v|version )3(?: 0)?
gpl-3 55 0.95 spdx | spdx license identifier gpl 3 0(?: only)?
gpl-3-or-later 60 0.97 gpl | spdx license identifier gpl 3 0 or later
gpl-3-or-later 62 0.97 general | gnu general public license (?:as published by the free software foundation )?(?:either )?version 3 (?:of the license )?or (?:at your option )?any later version
gpl-2 60 0.99 general | gnu general public licen[sc]e (?:as published by the free software foundation )?(?:either )?(?:v|version )2
gpl-2 50 0.95 gpl | gpl ?v?2(?: 0)?
gpl-2 50 0.95 gpl | (?:gnu )?gpl (?:v|version )2(?: 0)?
gpl-2 55 0.95 spdx | spdx license identifier gpl 2 0(?: only)?
gpl-2-or-later 60 0.97 gpl | spdx license identifier gpl 2 0 or later
gpl-2-or-later 62 0.97 general | gnu general public license (?:as published by the free software foundation )?(?:either )?version 2 (?:of the license )?or (?:at your option )?any later version
gpl-1 50 0.9 general | gnu general public licen[sc]e version 1
gpl 20 0.75 general | gnu general public licen[sc]e
gpl 10 0.6 gpl | gnu gpl
gpl 30 0.8 redistribute | redistribute it and or modify it under the terms of the gnu general public license
lgpl-3 60 0.97 lesser | gnu lesser general public licen[sc]e (?:as published by the free software foundation )?(?:either )?(?:v|version )3
lgpl-3 50 0.95 lgpl | lgpl ?v?3(?: 0)?
lgpl-3 55 0.95 lgpl | spdx license identifier lgpl 3 0(?: only| or later)?
lgpl-2.1 60 0.97 lesser | gnu lesser general public licen[sc]e (?:as published by the free software foundation )?(?:either )?(?:v|version )2 1
lgpl-2.1 50 0.95 lgpl | lgpl ?v?2 1
lgpl-2.1 55 0.95 lgpl | spdx license identifier lgpl 2 1(?: only| or later)?
lgpl-2 60 0.95 library | gnu library general public licen[sc]e(?: version 2)?
lgpl 20 0.75 lesser | gnu lesser general public licen[sc]e
lgpl 10 0.6 lgpl | (?:gnu )?lgpl
agpl-3 60 0.97 affero | gnu affero general public licen[sc]e (?:as published by the free software foundation )?(?:either )?(?:v|version )3
agpl-3 50 0.95 agpl | agpl ?v?3(?: 0)?
agpl-3 55 0.95 agpl | spdx license identifier agpl 3 0(?: only| or later)?
agpl 20 0.75 affero | (?:gnu )?affero general public licen[sc]e
gfdl-1.3 50 0.95 documentation | gnu free documentation licen[sc]e version 1 3
gfdl-1.2 50 0.95 documentation | gnu free documentation licen[sc]e version 1 2
gfdl-1.1 50 0.95 documentation | gnu free documentation licen[sc]e version 1 1
gfdl 20 0.8 documentation | gnu free documentation licen[sc]e
gfdl 10 0.6 gfdl | gfdl
bsd-2 50 0.95 bsd | (?:bsd 2 clause|2 clause bsd|two clause bsd|simplified bsd|freebsd)(?: licen[sc]e)?
bsd-2 55 0.95 spdx | spdx license identifier bsd 2 clause
bsd-3 50 0.95 bsd | (?:bsd 3 clause|3 clause bsd|three clause bsd|new bsd|modified bsd|revised bsd)(?: licen[sc]e)?
bsd-3 55 0.95 spdx | spdx license identifier bsd 3 clause
bsd-3 60 0.9 endorse | neither the name of (?:the )?(?:[^ ]+ ){1,8}nor the names of its contributors may be used to endorse or promote products
bsd-4 50 0.95 bsd | (?:bsd 4 clause|4 clause bsd|original bsd|old bsd)(?: licen[sc]e)?
bsd-4 60 0.95 advertising | all advertising materials mentioning features or use of this software must display the following acknowledg
0bsd 50 0.95 bsd | (?:0bsd|zero clause bsd|bsd zero clause)(?: licen[sc]e)?
bsd 40 0.85 redistribution | redistribution and use in source and binary forms with or without modification are permitted
bsd 20 0.75 bsd | bsd (?:style )?licen[sc]e
isc 55 0.95 isc | (?:the )?isc licen[sc]e
isc 55 0.95 spdx | spdx license identifier isc
isc 50 0.9 permission | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
mpl-2 50 0.95 mozilla | mozilla public licen[sc]e (?:v|version )?2(?: 0)?
mpl-2 50 0.95 mpl | mpl ?v?2(?: 0)?
mpl-2 60 0.97 mozilla | this source code form is subject to the terms of the mozilla public license v 2 0
mpl-1.1 50 0.95 mozilla | mozilla public licen[sc]e (?:v|version )?1 1
mpl-1.1 50 0.95 mpl | mpl ?v?1 1
mpl 20 0.75 mozilla | mozilla public licen[sc]e
epl-2 50 0.95 eclipse | eclipse public licen[sc]e (?:v|version )?2(?: 0)?
epl-2 50 0.95 epl | epl ?v?2 0
epl-1 50 0.95 eclipse | eclipse public licen[sc]e (?:v|version )?1(?: 0)?
epl-1 50 0.95 epl | epl ?v?1 0
epl 20 0.75 eclipse | eclipse public licen[sc]e
edl-1 50 0.9 eclipse | eclipse distribution licen[sc]e (?:v|version )?1(?: 0)?
eupl-1.2 50 0.95 european | european union public licen[sc]e (?:v|version )?1 2
eupl-1.1 50 0.95 european | european union public licen[sc]e (?:v|version )?1 1
eupl 20 0.75 european | european union public licen[sc]e
cddl-1.1 50 0.95 distribution | common development and distribution licen[sc]e (?:v|version )?1 1
cddl-1 50 0.95 distribution | common development and distribution licen[sc]e (?:v|version )?1 0
cddl 20 0.75 distribution | common development and distribution licen[sc]e
cpl-1 50 0.95 common | common public licen[sc]e (?:v|version )?1(?: 0)?
cpal-1 50 0.95 attribution | common public attribution licen[sc]e(?: (?:v|version )?1(?: 0)?)?
osl-3 50 0.95 open | open software licen[sc]e (?:v|version )?3(?: 0)?
osl 20 0.75 open | open software licen[sc]e
afl-3 50 0.95 academic | academic free licen[sc]e (?:v|version )?3(?: 0)?
afl 20 0.75 academic | academic free licen[sc]e
artistic-2 50 0.95 artistic | artistic licen[sc]e (?:v|version )?2(?: 0)?
artistic-1 50 0.9 artistic | artistic licen[sc]e (?:v|version )?1(?: 0)?
artistic 20 0.75 artistic | (?:perl )?artistic licen[sc]e
perl 40 0.9 perl | under the same terms as perl itself
zlib 50 0.9 zlib | zlib (?:libpng )?licen[sc]e
zlib 60 0.95 misrepresented | the origin of this software must not be misrepresented
libpng 50 0.9 libpng | libpng licen[sc]e
boost-1 50 0.95 boost | boost software licen[sc]e(?: (?:v|version )?1(?: 0)?)?
boost-1 55 0.95 spdx | spdx license identifier bsl 1 0
unlicense 60 0.97 public | this is free and unencumbered software released into the public domain
unlicense 50 0.9 unlicense | (?:the )?unlicense
wtfpl 50 0.95 want | do what the f[^ ]* you want to public licen[sc]e
wtfpl 40 0.9 wtfpl | wtfpl
beerware 40 0.9 beer | beer ?ware licen[sc]e
python-2 50 0.95 python | python software foundation licen[sc]e(?: version 2)?
python-2 40 0.9 psf | psf licen[sc]e
php-3 50 0.95 php | php licen[sc]e (?:v|version )?3(?: 01)?
ruby 40 0.9 ruby | ruby licen[sc]e
postgresql 50 0.95 postgresql | postgresql licen[sc]e
openssl 50 0.95 openssl | openssl licen[sc]e
vim 40 0.9 vim | vim licen[sc]e
w3c 50 0.9 w3c | w3c (?:software )?(?:notice and )?licen[sc]e
curl 40 0.9 curl | curl licen[sc]e
icu 40 0.9 icu | icu licen[sc]e
unicode 50 0.9 unicode | unicode (?:data files and software )?licen[sc]e
ncsa 50 0.95 illinois | university of illinois ncsa open source licen[sc]e
ncsa 40 0.85 ncsa | ncsa licen[sc]e
x11 40 0.9 x11 | x11 licen[sc]e
hpnd 40 0.85 historical | historical permission notice and disclaimer
ofl-1.1 50 0.95 font | sil open font licen[sc]e(?: (?:v|version )?1 1)?
ofl-1.1 40 0.9 ofl | ofl ?v?1 1
lppl-1.3 50 0.95 latex | latex project public licen[sc]e(?: (?:v|version )?1 3c?)?
ms-pl 50 0.95 microsoft | microsoft public licen[sc]e
ms-rl 50 0.95 microsoft | microsoft reciprocal licen[sc]e
upl-1 50 0.95 universal | universal permissive licen[sc]e(?: (?:v|version )?1(?: 0)?)?
blueoak-1 50 0.95 blue | blue oak model licen[sc]e(?: 1 0 0)?
mulan-2 50 0.95 mulan | mulan (?:psl|permissive software license) ?v?2
qpl-1 40 0.9 public | q public licen[sc]e(?: (?:v|version )?1 0)?
sleepycat 40 0.9 sleepycat | sleepycat licen[sc]e
sspl-1 50 0.95 server | server side public licen[sc]e(?: (?:v|version )?1)?
busl-1.1 50 0.95 business | business source licen[sc]e(?: (?:v|version )?1 1)?
elastic-2 50 0.95 elastic | elastic licen[sc]e(?: (?:v|version )?2(?: 0)?)?
commons-clause 50 0.95 clause | commons clause(?: license)? condition
polyform-nc 50 0.95 polyform | polyform noncommercial licen[sc]e(?: 1 0 0)?
polyform-sb 50 0.95 polyform | polyform small business licen[sc]e(?: 1 0 0)?
confluent 40 0.9 confluent | confluent community licen[sc]e
hippocratic 40 0.9 hippocratic | hippocratic licen[sc]e
json 50 0.9 evil | the software shall be used for good not evil
cc0-1 50 0.95 cc0 | cc0(?: 1 0)?(?: universal)?
cc0-1 55 0.95 creative | creative commons (?:cc0|zero)(?: 1 0)?(?: universal)?
cc-by-nc-nd-4 60 0.97 commons | creative commons attribution non ?commercial no ?deriv[a-z]* 4 0(?: international)?
cc-by-nc-nd 52 0.95 cc by | cc by nc nd(?: [1-4] [05])?
cc-by-nc-nd 55 0.95 commons | creative commons attribution non ?commercial no ?deriv[a-z]*
cc-by-nc-sa-4 60 0.97 commons | creative commons attribution non ?commercial share ?alike 4 0(?: international)?
cc-by-nc-sa-3 60 0.97 commons | creative commons attribution non ?commercial share ?alike 3 0(?: unported)?
cc-by-nc-sa 52 0.95 cc by | cc by nc sa(?: [1-4] [05])?
cc-by-nc-sa 55 0.95 commons | creative commons attribution non ?commercial share ?alike
cc-by-nc 60 0.99 cc by | cc by nc
cc-by-nc 62 0.97 cc by | licensed under cc by nc(?: [1-4] [05])?
cc-by-nc-4 64 0.95 cc by | cc by nc 4 0
cc-by-nc-3 64 0.95 cc by | cc by nc 3 0
cc-by-nc-4 60 0.97 commons | creative commons attribution non ?commercial 4 0(?: international)?
cc-by-nc-3 60 0.97 commons | creative commons attribution non ?commercial 3 0(?: unported)?
cc-by-nc 50 0.95 commons | creative commons attribution non ?commercial
cc-by-nd-4 60 0.97 commons | creative commons attribution no ?deriv[a-z]* 4 0(?: international)?
cc-by-nd 52 0.95 cc by | cc by nd(?: [1-4] [05])?
cc-by-nd 55 0.95 commons | creative commons attribution no ?deriv[a-z]*
cc-by-sa-4 60 0.97 commons | creative commons attribution share ?alike 4 0(?: international)?
cc-by-sa-3 60 0.97 commons | creative commons attribution share ?alike 3 0(?: unported)?
cc-by-sa-4 54 0.95 cc by | cc by sa 4 0
cc-by-sa-3 54 0.95 cc by | cc by sa 3 0
cc-by-sa 52 0.95 cc by | cc by sa
cc-by-sa 55 0.95 commons | creative commons attribution share ?alike
cc-by-4 56 0.97 commons | creative commons attribution 4 0(?: international)?
cc-by-3 56 0.97 commons | creative commons attribution 3 0(?: unported)?
cc-by-2 56 0.97 commons | creative commons attribution 2 [05](?: generic)?
cc-by-4 50 0.95 cc by | cc by 4 0
cc-by-3 50 0.95 cc by | cc by 3 0
cc-by 20 0.8 cc by | cc by
cc-by 20 0.8 commons | creative commons attribution(?: licen[sc]e)?
cc 10 0.6 commons | creative commons licen[sc]e
cc 30 0.8 creativecommons | creativecommons org licenses (?:by|by sa|by nd|by nc|by nc sa|by nc nd)
cc 30 0.8 creativecommons | creativecommons org publicdomain (?:zero|mark)
cc-sampling 40 0.9 sampling | creative commons sampling(?: plus)?
public-domain 40 0.9 public | (?:released|placed|dedicated|donated) (?:in|into|to) the public domain
public-domain 20 0.7 public | in the public domain
odbl-1 50 0.95 database | open (?:data commons open )?database licen[sc]e(?: (?:v|version )?1(?: 0)?)?
odbl-1 40 0.9 odbl | odbl(?: 1 0)?
odc-by-1 50 0.95 open | open data commons attribution licen[sc]e(?: (?:v|version )?1(?: 0)?)?
pddl-1 50 0.95 public | public domain dedication and licen[sc]e(?: (?:v|version )?1(?: 0)?)?
cdla-permissive-2 50 0.95 community | community data licen[sc]e agreement permissive(?: version)? 2(?: 0)?
cdla-permissive-1 50 0.95 community | community data licen[sc]e agreement permissive(?: version)? 1(?: 0)?
cdla-sharing-1 50 0.95 community | community data licen[sc]e agreement sharing(?: version)?(?: 1(?: 0)?)?
ogl-uk-3 50 0.95 government | open government licen[sc]e (?:v|version )?3(?: 0)?
ogl-uk 20 0.8 government | open government licen[sc]e
etalab-2 50 0.95 licen | (?:licence ouverte|open licen[sc]e)(?: etalab)? (?:v|version )?2(?: 0)?
dl-de-by-2 50 0.95 datenlizenz | datenlizenz deutschland namensnennung(?: version)? 2 0
cecill-2.1 50 0.95 cecill | cecill(?: version)? 2 1
cecill-b 50 0.95 cecill | cecill b
cecill-c 50 0.95 cecill | cecill c
cecill 20 0.8 cecill | cecill
openrail-m 50 0.95 rail | (?:creativeml |bigscience )?open ?rail(?: m)?(?: licen[sc]e)?
bigscience-rail 50 0.95 bigscience | bigscience rail licen[sc]e(?: (?:v|version )?1(?: 0)?)?
llama-2 50 0.95 llama | llama 2 community licen[sc]e(?: agreement)?
llama-3 50 0.95 llama | (?:meta )?llama 3(?: [123])? community licen[sc]e(?: agreement)?
gemma 50 0.9 gemma | gemma terms of use
intel 40 0.85 intel | intel (?:simplified software|open source) licen[sc]e
ibm 40 0.85 ibm | ibm public licen[sc]e(?: (?:v|version )?1(?: 0)?)?
nokia 40 0.85 nokia | nokia open source licen[sc]e
sun 40 0.85 sun | sun public licen[sc]e(?: (?:v|version )?1(?: 0)?)?
nasa-1.3 40 0.9 nasa | nasa open source agreement(?: (?:v|version )?1 3)?
apple-2 40 0.9 apple | apple public source licen[sc]e(?: (?:v|version )?2(?: 0)?)?
ecl-2 50 0.95 educational | educational community licen[sc]e (?:v|version )?2(?: 0)?
naumen 30 0.85 naumen | naumen public licen[sc]e
motosoto 30 0.85 motosoto | motosoto licen[sc]e
watcom 30 0.85 watcom | sybase open watcom public licen[sc]e
rpl-1.5 40 0.9 reciprocal | reciprocal public licen[sc]e(?: (?:v|version )?1 5)?
simpl-2 30 0.85 simple | simple public licen[sc]e(?: (?:v|version )?2 0)?
fair 30 0.85 fair | fair licen[sc]e
entessa 30 0.85 entessa | entessa public licen[sc]e
frameworx 30 0.85 frameworx | frameworx open licen[sc]e
multics 30 0.85 multics | multics licen[sc]e
xnet 30 0.85 x net | x net licen[sc]e
zope-2.1 40 0.9 zope | zope public licen[sc]e(?: (?:v|version )?2 1)?
cnri 40 0.9 cnri | cnri (?:open source )?(?:python )?licen[sc]e(?: agreement)?
proprietary 50 0.85 proprietary | proprietary and confidential
proprietary 40 0.8 proprietary | (?:under|subject to) (?:a|the|our) proprietary licen[sc]e
proprietary 40 0.8 required | (?:commercial|paid) licen[sc]e (?:is )?required
non-commercial 40 0.8 commercial | for non ?commercial (?:use|purposes) only
non-commercial 40 0.8 commercial | not for commercial use
no-derivatives 30 0.75 derivative | no derivative works (?:are )?(?:allowed|permitted)
no-redistribution 40 0.8 redistribut | (?:may not|must not|do not) (?:be )?redistribut[a-z]+
no-training 50 0.85 train | (?:may|must) not be used (?:for|in|to) (?:the )?train(?:ing)?(?: of)?(?: machine learning| ai| language| models?)+
all-rights-reserved 20 0.7 rights | all rights reserved
all-rights-reserved 20 0.7 rechte | alle rechte vorbehalten
all-rights-reserved 20 0.7 droits | tous droits r[^ ]+s
all-rights-reserved 20 0.7 derechos | todos los derechos reservados
copyright 10 0.5 copyright | copyright (?:c )?(?:19|20)[0-9][0-9](?: (?:19|20)[0-9][0-9])?
copyright 10 0.5 copyrighted | (?:this|the) [^ ]+ is copyrighted
license-reference 10 0.4 licens | see (?:the )?(?:accompanying |attached )?license(?: file| txt| md)?
license-reference 10 0.4 licens | licensed under (?:the )?(?:terms of )?the license
license-reference 10 0.4 lizenz | unter der [^ ]+ lizenz
license-reference 10 0.4 licence | sous (?:la )?licence [^ ]+
license-reference 10 0.4 licencia | bajo (?:la )?licencia [^ ]+
"""
