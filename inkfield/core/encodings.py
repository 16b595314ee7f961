"""TeX's font encodings: what the slots 0 to 127 are called, what the names mean, and which font has which encoding.

Factual tables of the Adobe Font Metrics files of the Computer Modern and AMS fonts and of LaTeX's and LaTeXML's symbol
declarations, as the surveyed project lists them (MIT License, Copyright (c) 2026 Adam DePrince)."""

# fmt: off
#: Encoding: names of the slots 0 to 127, - where there is none.
ENCODINGS = {
    "AMSA": (
        "squaredot squareplus squaremultiply square squaresolid squaresmallsolid diamond diamondsolid clockwise anticlockwise harpoonleftright harpoonrightleft "
        "squareminus forces forcesbar satisfies dblarrowheadright dblarrowheadleft dblarrowleft dblarrowright dblarrowup dblarrowdwn harpoonupright "
        "harpoondownright harpoonupleft harpoondownleft arrowtailright arrowtailleft arrowparrleftright arrowparrrightleft shiftleft shiftright squiggleright "
        "squiggleleftright curlyleft curlyright circleequal followsorequal greaterorsimilar greaterorapproxeql multimap therefore because equalsdots defines "
        "precedesorequal lessorsimilar lessorapproxeql equalorless equalorgreater equalorprecedes equalorfollows precedesorcurly lessdblequal lessorequalslant "
        "lessorgreater primereverse axisshort equaldotrightleft equaldotleftright followsorcurly greaterdblequal greaterorequalslant greaterorless squareimage "
        "squareoriginal triangleright triangleleft trianglerightequal triangleleftequal star between triangledownsld trianglerightsld triangleleftsld "
        "arrowaxisright arrowaxisleft triangle trianglesolid triangleinv ringinequal lessequalgreater greaterlessequal lessdbleqlgreater greaterdbleqlless Yen "
        "arrowtripleright arrowtripleleft check orunderscore nand perpcorrespond angle measuredangle sphericalangle proportional smile frown subsetdbl "
        "supersetdbl uniondbl intersectiondbl uprise downfall multiopenleft multiopenright subsetdblequal supersetdblequal difference geomequivalent muchless "
        "muchgreater rightanglenw rightanglene circleR circleS fork dotplus revsimilar revasymptequal rightanglesw rightanglese maltesecross complement "
        "intercal circlering circleasterisk circleminus "
    ),
    "AMSB": (
        "lessornotequal greaterornotequal notlessequal notgreaterequal notless notgreater notprecedes notfollows lessornotdbleql greaterornotdbleql "
        "notlessorslnteql notgreaterorslnteql lessnotequal greaternotequal notprecedesoreql notfollowsoreql precedeornoteqvlnt followornoteqvlnt "
        "lessornotsimilar greaterornotsimilar notlessdblequal notgreaterdblequal precedenotslnteql follownotslnteql precedenotdbleqv follownotdbleqv "
        "lessnotdblequal greaternotdblequal notsimilar notapproxequal upslope downslope notsubsetoreql notsupersetoreql notsubsetordbleql notsupersetordbleql "
        "subsetornotdbleql supersetornotdbleql subsetornoteql supersetornoteql subsetnoteql supersetnoteql notsubseteql notsuperseteql notparallel notbar "
        "notshortbar notshortparallel notturnstile notforces notsatisfies notforcesextra nottriangeqlright nottriangeqlleft nottriangleleft nottriangleright "
        "notarrowleft notarrowright notdblarrowleft notdblarrowright notdblarrowboth notarrowboth dividemultiply emptyset notexistential A B C D E F G H I J K "
        "L M N O P Q R S T U V W X Y Z hatwide hatwider tildewide tildewider - Finv Gmir - - - - Omegainv eth equalorsimilar beth gimel daleth lessdot "
        "greaterdot multicloseleft multicloseright barshort parallelshort integerdivide similar approxequal approxorequal followsorequal precedesorequal "
        "archleftdown archrightdown Digamma kappa k planckover2pi planckover2pi1 epsiloninv "
    ),
    "CMSS": (
        "Gamma Delta Theta Lambda Xi Pi Sigma Upsilon Phi Psi Omega ff fi fl ffi ffl dotlessi dotlessj grave acute caron breve macron ring cedilla germandbls "
        "ae oe oslash AE OE Oslash suppress exclam quotedblright numbersign dollar percent ampersand quoteright parenleft parenright asterisk plus comma hyphen "
        "period slash zero one two three four five six seven eight nine colon semicolon exclamdown equal questiondown question at A B C D E F G H I J K L M N O "
        "P Q R S T U V W X Y Z bracketleft quotedblleft bracketright circumflex dotaccent quoteleft a b c d e f g h i j k l m n o p q r s t u v w x y z endash "
        "emdash hungarumlaut tilde dieresis "
    ),
    "CMTI": (
        "Gamma Delta Theta Lambda Xi Pi Sigma Upsilon Phi Psi Omega ff fi fl ffi ffl dotlessi dotlessj grave acute caron breve macron ring cedilla germandbls "
        "ae oe oslash AE OE Oslash suppress exclam quotedblright numbersign sterling percent ampersand quoteright parenleft parenright asterisk plus comma "
        "hyphen period slash zero one two three four five six seven eight nine colon semicolon exclamdown equal questiondown question at A B C D E F G H I J K "
        "L M N O P Q R S T U V W X Y Z bracketleft quotedblleft bracketright circumflex dotaccent quoteleft a b c d e f g h i j k l m n o p q r s t u v w x y z "
        "endash emdash hungarumlaut tilde dieresis "
    ),
    "EUFRAK": (
        "dnos dalt fnos falt galt kalt talt ualt - - - - - - - - - - quoteleft quoteright - - - - - - - - - - - - space exclam - - - - ampersand quotesingle "
        "parenleft parenright asterisk plus comma minus period slash zero one two three four five six seven eight nine colon semicolon - equal - question - A B "
        "C D E F G H I J K L M N O P Q R S T U V W X Y Z bracketleft - bracketright asciicircum - - a b c d e f g h i j k l m n o p q r s t u v w x y z - - "
        "quotedbl - onealt "
    ),
    "LASY": (
        "- a1 a2 a3 a4 - - - - - - - - - - - - - - - - - - - - - - - - - - - space - - - - - - - a40 a41 a42 a43 - - - - a48 a49 a50 a51 - - - - - - a58 a59 "
        "a60 a61 - - - - - - - - - - - - - - - - - - - - - - - - - - - - - - - - - - - - - - - - - - - - - - - - - - - - - - - - - - - - - - - - - - "
    ),
    "OML": (
        "Gamma Delta Theta Lambda Xi Pi Sigma Upsilon Phi Psi Omega alpha beta gamma delta epsilon1 zeta eta theta iota kappa lambda mu nu xi pi rho sigma tau "
        "upsilon phi chi psi omega epsilon theta1 pi1 rho1 sigma1 phi1 arrowlefttophalf arrowleftbothalf arrowrighttophalf arrowrightbothalf arrowhookleft "
        "arrowhookright triangleright triangleleft zerooldstyle oneoldstyle twooldstyle threeoldstyle fouroldstyle fiveoldstyle sixoldstyle sevenoldstyle "
        "eightoldstyle nineoldstyle period comma less slash greater star partialdiff A B C D E F G H I J K L M N O P Q R S T U V W X Y Z flat natural sharp "
        "slurbelow slurabove lscript a b c d e f g h i j k l m n o p q r s t u v w x y z dotlessi dotlessj weierstrass vector tie "
    ),
    "OMS": (
        "minus periodcentered multiply asteriskmath divide diamondmath plusminus minusplus circleplus circleminus circlemultiply circledivide circledot "
        "circlecopyrt openbullet bullet equivasymptotic equivalence reflexsubset reflexsuperset lessequal greaterequal precedesequal followsequal similar "
        "approxequal propersubset propersuperset lessmuch greatermuch precedes follows arrowleft arrowright arrowup arrowdown arrowboth arrownortheast "
        "arrowsoutheast similarequal arrowdblleft arrowdblright arrowdblup arrowdbldown arrowdblboth arrownorthwest arrowsouthwest proportional prime infinity "
        "element owner triangle triangleinv negationslash mapsto universal existential logicalnot emptyset Rfractur Ifractur latticetop perpendicular aleph A B "
        "C D E F G H I J K L M N O P Q R S T U V W X Y Z union intersection unionmulti logicaland logicalor turnstileleft turnstileright floorleft floorright "
        "ceilingleft ceilingright braceleft braceright angbracketleft angbracketright bar bardbl arrowbothv arrowdblbothv backslash wreathproduct radical "
        "coproduct nabla integral unionsq intersectionsq subsetsqequal supersetsqequal section dagger daggerdbl paragraph club diamond heart spade "
    ),
    "OMX": (
        "parenleftbig parenrightbig bracketleftbig bracketrightbig floorleftbig floorrightbig ceilingleftbig ceilingrightbig braceleftbig bracerightbig "
        "angbracketleftbig angbracketrightbig vextendsingle vextenddouble slashbig backslashbig parenleftBig parenrightBig parenleftbigg parenrightbigg "
        "bracketleftbigg bracketrightbigg floorleftbigg floorrightbigg ceilingleftbigg ceilingrightbigg braceleftbigg bracerightbigg angbracketleftbigg "
        "angbracketrightbigg slashbigg backslashbigg parenleftBigg parenrightBigg bracketleftBigg bracketrightBigg floorleftBigg floorrightBigg ceilingleftBigg "
        "ceilingrightBigg braceleftBigg bracerightBigg angbracketleftBigg angbracketrightBigg slashBigg backslashBigg slashBig backslashBig parenlefttp "
        "parenrighttp bracketlefttp bracketrighttp bracketleftbt bracketrightbt bracketleftex bracketrightex bracelefttp bracerighttp braceleftbt bracerightbt "
        "braceleftmid bracerightmid braceex arrowvertex parenleftbt parenrightbt parenleftex parenrightex angbracketleftBig angbracketrightBig unionsqtext "
        "unionsqdisplay contintegraltext contintegraldisplay circledottext circledotdisplay circleplustext circleplusdisplay circlemultiplytext "
        "circlemultiplydisplay summationtext producttext integraltext uniontext intersectiontext unionmultitext logicalandtext logicalortext summationdisplay "
        "productdisplay integraldisplay uniondisplay intersectiondisplay unionmultidisplay logicalanddisplay logicalordisplay coproducttext coproductdisplay "
        "hatwide hatwider hatwidest tildewide tildewider tildewidest bracketleftBig bracketrightBig floorleftBig floorrightBig ceilingleftBig ceilingrightBig "
        "braceleftBig bracerightBig radicalbig radicalBig radicalbigg radicalBigg radicalbt radicalvertex radicaltp arrowvertexdbl arrowtp arrowbt "
        "bracehtipdownleft bracehtipdownright bracehtipupleft bracehtipupright arrowdbltp arrowdblbt "
    ),
    "OT1": (
        "Gamma Delta Theta Lambda Xi Pi Sigma Upsilon Phi Psi Omega ff fi fl ffi ffl dotlessi dotlessj grave acute caron breve macron ring cedilla germandbls "
        "ae oe oslash AE OE Oslash suppress exclam quotedblright numbersign dollar percent ampersand quoteright parenleft parenright asterisk plus comma hyphen "
        "period slash zero one two three four five six seven eight nine colon semicolon exclamdown equal questiondown question at A B C D E F G H I J K L M N O "
        "P Q R S T U V W X Y Z bracketleft quotedblleft bracketright circumflex dotaccent quoteleft a b c d e f g h i j k l m n o p q r s t u v w x y z endash "
        "emdash hungarumlaut tilde dieresis "
    ),
    "OT1TT": (
        "Gamma Delta Theta Lambda Xi Pi Sigma Upsilon Phi Psi Omega arrowup arrowdown quotesingle exclamdown questiondown dotlessi dotlessj grave acute caron "
        "breve macron ring cedilla germandbls ae oe oslash AE OE Oslash visiblespace exclam quotedbl numbersign dollar percent ampersand quoteright parenleft "
        "parenright asterisk plus comma hyphen period slash zero one two three four five six seven eight nine colon semicolon less equal greater question at A "
        "B C D E F G H I J K L M N O P Q R S T U V W X Y Z bracketleft backslash bracketright asciicircum underscore quoteleft a b c d e f g h i j k l m n o p "
        "q r s t u v w x y z braceleft bar braceright asciitilde dieresis "
    ),
}
#: Name: character and atom class, in any encoding.
SYMBOLS = {
    "alpha": ("α", "Ord"), "beta": ("β", "Ord"), "gamma": ("γ", "Ord"), "delta": ("δ", "Ord"), "epsilon1": ("ϵ", "Ord"), "epsilon": ("ε", "Ord"), "zeta": ("ζ", "Ord"),
    "eta": ("η", "Ord"), "theta": ("θ", "Ord"), "theta1": ("ϑ", "Ord"), "iota": ("ι", "Ord"), "kappa": ("κ", "Ord"), "lambda": ("λ", "Ord"), "mu": ("μ", "Ord"),
    "nu": ("ν", "Ord"), "xi": ("ξ", "Ord"), "pi": ("π", "Ord"), "pi1": ("ϖ", "Ord"), "rho": ("ρ", "Ord"), "rho1": ("ϱ", "Ord"), "sigma": ("σ", "Ord"),
    "sigma1": ("ς", "Ord"), "tau": ("τ", "Ord"), "upsilon": ("υ", "Ord"), "phi": ("ϕ", "Ord"), "phi1": ("φ", "Ord"), "chi": ("χ", "Ord"), "psi": ("ψ", "Ord"),
    "omega": ("ω", "Ord"), "Gamma": ("Γ", "Ord"), "Delta": ("Δ", "Ord"), "Theta": ("Θ", "Ord"), "Lambda": ("Λ", "Ord"), "Xi": ("Ξ", "Ord"), "Pi": ("Π", "Ord"),
    "Sigma": ("Σ", "Ord"), "Upsilon": ("Υ", "Ord"), "Phi": ("Φ", "Ord"), "Psi": ("Ψ", "Ord"), "Omega": ("Ω", "Ord"), "zero": ("0", "Ord"),
    "zerooldstyle": ("0", "Ord"), "one": ("1", "Ord"), "oneoldstyle": ("1", "Ord"), "two": ("2", "Ord"), "twooldstyle": ("2", "Ord"), "three": ("3", "Ord"),
    "threeoldstyle": ("3", "Ord"), "four": ("4", "Ord"), "fouroldstyle": ("4", "Ord"), "five": ("5", "Ord"), "fiveoldstyle": ("5", "Ord"), "six": ("6", "Ord"),
    "sixoldstyle": ("6", "Ord"), "seven": ("7", "Ord"), "sevenoldstyle": ("7", "Ord"), "eight": ("8", "Ord"), "eightoldstyle": ("8", "Ord"), "nine": ("9", "Ord"),
    "nineoldstyle": ("9", "Ord"), "period": (".", "Ord"), "comma": (",", "Punct"), "semicolon": (";", "Punct"), "colon": (":", "Rel"), "exclam": ("!", "Close"),
    "question": ("?", "Close"), "slash": ("/", "Ord"), "backslash": ("∖", "Ord"), "bar": ("|", "Ord"), "bardbl": ("‖", "Ord"), "dotlessi": ("ı", "Ord"),
    "dotlessj": ("ȷ", "Ord"), "quoteright": ("’", "Ord"), "quoteleft": ("‘", "Ord"), "hyphen": ("-", "Ord"), "endash": ("–", "Ord"), "emdash": ("—", "Ord"),
    "percent": ("%", "Ord"), "ampersand": ("&", "Ord"), "numbersign": ("#", "Ord"), "dollar": ("$", "Ord"), "at": ("@", "Ord"), "fi": ("fi", "Ord"),
    "fl": ("fl", "Ord"), "ff": ("ff", "Ord"), "ffi": ("ffi", "Ord"), "ffl": ("ffl", "Ord"), "plus": ("+", "Bin"), "minus": ("−", "Bin"),
    "periodcentered": ("⋅", "Bin"), "multiply": ("×", "Bin"), "asteriskmath": ("∗", "Bin"), "divide": ("÷", "Bin"), "diamondmath": ("⋄", "Bin"),
    "plusminus": ("±", "Bin"), "minusplus": ("∓", "Bin"), "circleplus": ("⊕", "Bin"), "circleminus": ("⊖", "Bin"), "circlemultiply": ("⊗", "Bin"),
    "circledivide": ("⊘", "Bin"), "circledot": ("⊙", "Bin"), "circlecopyrt": ("©", "Ord"), "openbullet": ("◦", "Bin"), "bullet": ("∙", "Bin"), "union": ("∪", "Bin"),
    "intersection": ("∩", "Bin"), "unionmulti": ("⊎", "Bin"), "logicaland": ("∧", "Bin"), "logicalor": ("∨", "Bin"), "unionsq": ("⊔", "Bin"),
    "intersectionsq": ("⊓", "Bin"), "wreathproduct": ("≀", "Bin"), "dagger": ("†", "Bin"), "daggerdbl": ("‡", "Bin"), "triangle": ("△", "Ord"),
    "triangleinv": ("▽", "Ord"), "triangleleft": ("◁", "Bin"), "triangleright": ("▷", "Bin"), "star": ("⋆", "Bin"), "equal": ("=", "Rel"), "less": ("<", "Rel"),
    "greater": (">", "Rel"), "equivasymptotic": ("≍", "Rel"), "equivalence": ("≡", "Rel"), "reflexsubset": ("⊆", "Rel"), "reflexsuperset": ("⊇", "Rel"),
    "lessequal": ("≤", "Rel"), "greaterequal": ("≥", "Rel"), "precedesequal": ("⪯", "Rel"), "followsequal": ("⪰", "Rel"), "similar": ("∼", "Rel"),
    "approxequal": ("≈", "Rel"), "propersubset": ("⊂", "Rel"), "propersuperset": ("⊃", "Rel"), "lessmuch": ("≪", "Rel"), "greatermuch": ("≫", "Rel"),
    "precedes": ("≺", "Rel"), "follows": ("≻", "Rel"), "similarequal": ("≃", "Rel"), "proportional": ("∝", "Rel"), "element": ("∈", "Rel"), "owner": ("∋", "Rel"),
    "negationslash": ("̸", "Ord"), "mapsto": ("↦", "Rel"), "turnstileleft": ("⊢", "Rel"), "turnstileright": ("⊣", "Rel"), "subsetsqequal": ("⊑", "Rel"),
    "supersetsqequal": ("⊒", "Rel"), "perpendicular": ("⊥", "Ord"), "latticetop": ("⊤", "Ord"), "arrowleft": ("←", "Rel"), "arrowright": ("→", "Rel"),
    "arrowup": ("↑", "Rel"), "arrowdown": ("↓", "Rel"), "arrowboth": ("↔", "Rel"), "arrowbothv": ("↕", "Ord"), "arrownortheast": ("↗", "Rel"),
    "arrowsoutheast": ("↘", "Rel"), "arrownorthwest": ("↖", "Rel"), "arrowsouthwest": ("↙", "Rel"), "arrowdblleft": ("⇐", "Rel"), "arrowdblright": ("⇒", "Rel"),
    "arrowdblup": ("⇑", "Rel"), "arrowdbldown": ("⇓", "Rel"), "arrowdblboth": ("⇔", "Rel"), "arrowdblbothv": ("⇕", "Ord"), "arrowhookleft": ("↩", "Rel"),
    "arrowhookright": ("↪", "Rel"), "arrowlefttophalf": ("↼", "Rel"), "arrowleftbothalf": ("↽", "Rel"), "arrowrighttophalf": ("⇀", "Rel"),
    "arrowrightbothalf": ("⇁", "Rel"), "infinity": ("∞", "Ord"), "prime": ("′", "Ord"), "partialdiff": ("∂", "Ord"), "nabla": ("∇", "Ord"), "universal": ("∀", "Ord"),
    "existential": ("∃", "Ord"), "logicalnot": ("¬", "Ord"), "emptyset": ("∅", "Ord"), "aleph": ("ℵ", "Ord"), "Rfractur": ("ℜ", "Ord"), "Ifractur": ("ℑ", "Ord"),
    "weierstrass": ("℘", "Ord"), "lscript": ("ℓ", "Ord"), "flat": ("♭", "Ord"), "natural": ("♮", "Ord"), "sharp": ("♯", "Ord"), "club": ("♣", "Ord"),
    "diamond": ("♢", "Ord"), "heart": ("♡", "Ord"), "spade": ("♠", "Ord"), "section": ("§", "Ord"), "paragraph": ("¶", "Ord"), "ellipsis": ("…", "Ord"),
    "parenleft": ("(", "Open"), "parenright": (")", "Close"), "bracketleft": ("[", "Open"), "bracketright": ("]", "Close"), "braceleft": ("{", "Open"),
    "braceright": ("}", "Close"), "angbracketleft": ("⟨", "Open"), "angbracketright": ("⟩", "Close"), "floorleft": ("⌊", "Open"), "floorright": ("⌋", "Close"),
    "ceilingleft": ("⌈", "Open"), "ceilingright": ("⌉", "Close"), "vextendsingle": ("|", "Ord"), "vextenddouble": ("‖", "Ord"), "radical": ("√", "Ord"),
    "coproduct": ("∐", "Op"), "integral": ("∫", "Op"), "summation": ("∑", "Op"), "product": ("∏", "Op"), "contintegral": ("∮", "Op"), "circumflex": ("̂", "Ord"),
    "tilde": ("̃", "Ord"), "macron": ("̄", "Ord"), "breve": ("̆", "Ord"), "dotaccent": ("̇", "Ord"), "dieresis": ("̈", "Ord"), "ring": ("̊", "Ord"),
    "acute": ("́", "Ord"), "grave": ("̀", "Ord"), "hungarumlaut": ("̋", "Ord"), "caron": ("̌", "Ord"), "cedilla": ("̧", "Ord"), "vector": ("⃗", "Ord"),
    "tie": ("͡", "Ord"),
}
#: (Encoding, name): the same, where the name alone does not say.
EXTRA_SYMBOLS = {
    ("AMSA", "anticlockwise"): ("↺", "Rel"), ("AMSA", "arrowparrleftright"): ("⇆", "Rel"), ("AMSA", "arrowparrrightleft"): ("⇄", "Rel"),
    ("AMSA", "arrowtailleft"): ("↢", "Rel"), ("AMSA", "arrowtailright"): ("↣", "Rel"), ("AMSA", "arrowtripleleft"): ("⇚", "Rel"),
    ("AMSA", "arrowtripleright"): ("⇛", "Rel"), ("AMSA", "because"): ("∵", "Rel"), ("AMSA", "between"): ("≬", "Rel"), ("AMSA", "circleS"): ("Ⓢ", "Ord"),
    ("AMSA", "circleasterisk"): ("⊛", "Bin"), ("AMSA", "circleequal"): ("≗", "Rel"), ("AMSA", "circlering"): ("⊚", "Bin"), ("AMSA", "clockwise"): ("↻", "Rel"),
    ("AMSA", "complement"): ("∁", "Ord"), ("AMSA", "curlyleft"): ("↫", "Rel"), ("AMSA", "curlyright"): ("↬", "Rel"), ("AMSA", "dblarrowdwn"): ("⇊", "Rel"),
    ("AMSA", "dblarrowheadleft"): ("↞", "Rel"), ("AMSA", "dblarrowheadright"): ("↠", "Rel"), ("AMSA", "dblarrowleft"): ("⇇", "Rel"),
    ("AMSA", "dblarrowright"): ("⇉", "Rel"), ("AMSA", "dblarrowup"): ("⇈", "Rel"), ("AMSA", "defines"): ("≜", "Rel"), ("AMSA", "diamondsolid"): ("◆", "Ord"),
    ("AMSA", "difference"): ("≏", "Rel"), ("AMSA", "dotplus"): ("∔", "Bin"), ("AMSA", "downfall"): ("⋎", "Bin"), ("AMSA", "equaldotleftright"): ("≒", "Rel"),
    ("AMSA", "equaldotrightleft"): ("≓", "Rel"), ("AMSA", "equalorfollows"): ("⋟", "Rel"), ("AMSA", "equalorgreater"): ("⪖", "Rel"),
    ("AMSA", "equalorless"): ("⪕", "Rel"), ("AMSA", "equalorprecedes"): ("⋞", "Rel"), ("AMSA", "equalsdots"): ("≑", "Rel"), ("AMSA", "followsorcurly"): ("≽", "Rel"),
    ("AMSA", "followsorequal"): ("≿", "Rel"), ("AMSA", "forces"): ("⊩", "Rel"), ("AMSA", "forcesbar"): ("⊪", "Rel"), ("AMSA", "fork"): ("⋔", "Rel"),
    ("AMSA", "frown"): ("⌢", "Rel"), ("AMSA", "geomequivalent"): ("≎", "Rel"), ("AMSA", "greaterdbleqlless"): ("⪌", "Rel"), ("AMSA", "greaterdblequal"): ("≧", "Rel"),
    ("AMSA", "greaterlessequal"): ("⋛", "Rel"), ("AMSA", "greaterorapproxeql"): ("⪆", "Rel"), ("AMSA", "greaterorequalslant"): ("⩾", "Rel"),
    ("AMSA", "greaterorless"): ("≷", "Rel"), ("AMSA", "greaterorsimilar"): ("≳", "Rel"), ("AMSA", "harpoondownleft"): ("⇃", "Rel"),
    ("AMSA", "harpoondownright"): ("⇂", "Rel"), ("AMSA", "harpoonrightleft"): ("⇋", "Rel"), ("AMSA", "harpoonupleft"): ("↿", "Rel"),
    ("AMSA", "harpoonupright"): ("↾", "Rel"), ("AMSA", "intercal"): ("⊺", "Bin"), ("AMSA", "intersectiondbl"): ("⋒", "Bin"),
    ("AMSA", "lessdbleqlgreater"): ("⪋", "Rel"), ("AMSA", "lessdblequal"): ("≦", "Rel"), ("AMSA", "lessequalgreater"): ("⋚", "Rel"),
    ("AMSA", "lessorapproxeql"): ("⪅", "Rel"), ("AMSA", "lessorequalslant"): ("⩽", "Rel"), ("AMSA", "lessorgreater"): ("≶", "Rel"),
    ("AMSA", "lessorsimilar"): ("≲", "Rel"), ("AMSA", "measuredangle"): ("∡", "Ord"), ("AMSA", "muchgreater"): ("⋙", "Rel"), ("AMSA", "muchless"): ("⋘", "Rel"),
    ("AMSA", "multimap"): ("⊸", "Rel"), ("AMSA", "multiopenleft"): ("⋋", "Bin"), ("AMSA", "multiopenright"): ("⋌", "Bin"), ("AMSA", "nand"): ("⊼", "Bin"),
    ("AMSA", "orunderscore"): ("⊻", "Bin"), ("AMSA", "perpcorrespond"): ("⩞", "Bin"), ("AMSA", "precedesorcurly"): ("≼", "Rel"),
    ("AMSA", "precedesorequal"): ("≾", "Rel"), ("AMSA", "primereverse"): ("‵", "Ord"), ("AMSA", "revasymptequal"): ("≌", "Rel"), ("AMSA", "revsimilar"): ("∽", "Rel"),
    ("AMSA", "ringinequal"): ("≖", "Rel"), ("AMSA", "satisfies"): ("⊨", "Rel"), ("AMSA", "shiftleft"): ("↰", "Rel"), ("AMSA", "shiftright"): ("↱", "Rel"),
    ("AMSA", "smile"): ("⌣", "Rel"), ("AMSA", "sphericalangle"): ("∢", "Ord"), ("AMSA", "square"): ("□", "Ord"), ("AMSA", "squaredot"): ("⊡", "Bin"),
    ("AMSA", "squareminus"): ("⊟", "Bin"), ("AMSA", "squaremultiply"): ("⊠", "Bin"), ("AMSA", "squareplus"): ("⊞", "Bin"), ("AMSA", "squaresmallsolid"): ("∙", "Bin"),
    ("AMSA", "squaresolid"): ("■", "Ord"), ("AMSA", "squiggleleftright"): ("↭", "Rel"), ("AMSA", "squiggleright"): ("↝", "Rel"), ("AMSA", "subsetdbl"): ("⋐", "Rel"),
    ("AMSA", "subsetdblequal"): ("⫅", "Rel"), ("AMSA", "supersetdbl"): ("⋑", "Rel"), ("AMSA", "supersetdblequal"): ("⫆", "Rel"), ("AMSA", "therefore"): ("∴", "Rel"),
    ("AMSA", "triangledownsld"): ("▼", "Ord"), ("AMSA", "triangleleftequal"): ("⊴", "Bin"), ("AMSA", "triangleleftsld"): ("◀", "Rel"),
    ("AMSA", "trianglerightequal"): ("⊵", "Bin"), ("AMSA", "trianglerightsld"): ("▶", "Rel"), ("AMSA", "trianglesolid"): ("▲", "Ord"),
    ("AMSA", "uniondbl"): ("⋓", "Bin"), ("AMSA", "uprise"): ("⋏", "Bin"), ("AMSB", "Digamma"): ("ϝ", "Ord"), ("AMSB", "Finv"): ("Ⅎ", "Ord"),
    ("AMSB", "Gmir"): ("⅁", "Ord"), ("AMSB", "approxorequal"): ("≊", "Rel"), ("AMSB", "archleftdown"): ("↶", "Rel"), ("AMSB", "archrightdown"): ("↷", "Rel"),
    ("AMSB", "barshort"): ("∣", "Rel"), ("AMSB", "beth"): ("ℶ", "Ord"), ("AMSB", "daleth"): ("ℸ", "Ord"), ("AMSB", "dividemultiply"): ("⋇", "Bin"),
    ("AMSB", "downslope"): ("╲", "Ord"), ("AMSB", "epsiloninv"): ("϶", "Rel"), ("AMSB", "equalorsimilar"): ("≂", "Rel"), ("AMSB", "follownotdbleqv"): ("⪺", "Rel"),
    ("AMSB", "follownotslnteql"): ("⪶", "Rel"), ("AMSB", "followornoteqvlnt"): ("⋩", "Rel"), ("AMSB", "followsorequal"): ("⪸", "Rel"), ("AMSB", "gimel"): ("ℷ", "Ord"),
    ("AMSB", "greaterdot"): ("⋗", "Rel"), ("AMSB", "greaternotdblequal"): ("⪊", "Rel"), ("AMSB", "greaternotequal"): ("⪈", "Rel"),
    ("AMSB", "greaterornotdbleql"): ("≩", "Rel"), ("AMSB", "greaterornotequal"): ("≩", "Rel"), ("AMSB", "greaterornotsimilar"): ("⋧", "Rel"),
    ("AMSB", "integerdivide"): ("∖", "Bin"), ("AMSB", "lessdot"): ("⋖", "Rel"), ("AMSB", "lessnotdblequal"): ("⪉", "Rel"), ("AMSB", "lessnotequal"): ("⪇", "Rel"),
    ("AMSB", "lessornotdbleql"): ("≨", "Rel"), ("AMSB", "lessornotequal"): ("≨", "Rel"), ("AMSB", "lessornotsimilar"): ("⋦", "Rel"),
    ("AMSB", "multicloseleft"): ("⋉", "Bin"), ("AMSB", "multicloseright"): ("⋊", "Bin"), ("AMSB", "notapproxequal"): ("≇", "Rel"),
    ("AMSB", "notarrowboth"): ("↮", "Rel"), ("AMSB", "notarrowleft"): ("↚", "Rel"), ("AMSB", "notarrowright"): ("↛", "Rel"), ("AMSB", "notbar"): ("∤", "Rel"),
    ("AMSB", "notdblarrowboth"): ("⇎", "Rel"), ("AMSB", "notdblarrowleft"): ("⇍", "Rel"), ("AMSB", "notdblarrowright"): ("⇏", "Rel"),
    ("AMSB", "notexistential"): ("∄", "Ord"), ("AMSB", "notfollows"): ("⊁", "Rel"), ("AMSB", "notfollowsoreql"): ("⋡", "Rel"), ("AMSB", "notforces"): ("⊮", "Rel"),
    ("AMSB", "notforcesextra"): ("⊯", "Rel"), ("AMSB", "notgreater"): ("≯", "Rel"), ("AMSB", "notgreaterdblequal"): ("≧̸", "Rel"),
    ("AMSB", "notgreaterequal"): ("≱", "Rel"), ("AMSB", "notgreaterorslnteql"): ("⩾̸", "Rel"), ("AMSB", "notless"): ("≮", "Rel"),
    ("AMSB", "notlessdblequal"): ("≦̸", "Rel"), ("AMSB", "notlessequal"): ("≰", "Rel"), ("AMSB", "notlessorslnteql"): ("⩽̸", "Rel"),
    ("AMSB", "notparallel"): ("∦", "Rel"), ("AMSB", "notprecedes"): ("⊀", "Rel"), ("AMSB", "notprecedesoreql"): ("⋠", "Rel"), ("AMSB", "notsatisfies"): ("⊭", "Rel"),
    ("AMSB", "notshortbar"): ("∤", "Rel"), ("AMSB", "notshortparallel"): ("∦", "Rel"), ("AMSB", "notsimilar"): ("≁", "Rel"), ("AMSB", "notsubseteql"): ("⊈", "Rel"),
    ("AMSB", "notsubsetordbleql"): ("⫅̸", "Rel"), ("AMSB", "notsubsetoreql"): ("⊊", "Rel"), ("AMSB", "notsuperseteql"): ("⊉", "Rel"),
    ("AMSB", "notsupersetordbleql"): ("⫆̸", "Rel"), ("AMSB", "notsupersetoreql"): ("⊋", "Rel"), ("AMSB", "nottriangeqlleft"): ("⋬", "Rel"),
    ("AMSB", "nottriangeqlright"): ("⋭", "Rel"), ("AMSB", "nottriangleleft"): ("⋪", "Rel"), ("AMSB", "nottriangleright"): ("⋫", "Rel"),
    ("AMSB", "notturnstile"): ("⊬", "Rel"), ("AMSB", "parallelshort"): ("∥", "Rel"), ("AMSB", "planckover2pi"): ("ℏ", "Ord"),
    ("AMSB", "precedenotdbleqv"): ("⪹", "Rel"), ("AMSB", "precedenotslnteql"): ("⪵", "Rel"), ("AMSB", "precedeornoteqvlnt"): ("⋨", "Rel"),
    ("AMSB", "precedesorequal"): ("⪷", "Rel"), ("AMSB", "subsetnoteql"): ("⊊", "Rel"), ("AMSB", "subsetornotdbleql"): ("⫋", "Rel"),
    ("AMSB", "subsetornoteql"): ("⫋", "Rel"), ("AMSB", "supersetnoteql"): ("⊋", "Rel"), ("AMSB", "supersetornotdbleql"): ("⫌", "Rel"),
    ("AMSB", "supersetornoteql"): ("⫌", "Rel"), ("AMSB", "upslope"): ("╱", "Ord"), ("LASY", "a1"): ("⊲", "Bin"), ("LASY", "a2"): ("⊴", "Bin"),
    ("LASY", "a3"): ("⊳", "Bin"), ("LASY", "a4"): ("⊵", "Bin"), ("LASY", "a48"): ("℧", "Ord"), ("LASY", "a49"): ("⋈", "Rel"), ("LASY", "a50"): ("□", "Ord"),
    ("LASY", "a51"): ("◊", "Ord"), ("LASY", "a59"): ("⇝", "Rel"), ("LASY", "a60"): ("⊏", "Rel"), ("LASY", "a61"): ("⊐", "Rel"),
}
#: Base of a large operator: character.
LARGE_OPERATORS = {
    "summation": "∑", "product": "∏", "coproduct": "∐", "integral": "∫", "contintegral": "∮", "union": "⋃", "intersection": "⋂", "unionmulti": "⨄", "unionsq": "⨆",
    "logicaland": "⋀", "logicalor": "⋁", "circledot": "⨀", "circleplus": "⨁", "circlemultiply": "⨂",
}
#: Family: encoding, variant of its letters.
FAMILIES = {
    "cmr": ("OT1", "normal"), "cmb": ("OT1", "bold"), "cmbx": ("OT1", "bold"), "cmsl": ("OT1", "italic"), "cmbxsl": ("OT1", "bold-italic"), "cmti": ("CMTI", "italic"),
    "cmbxti": ("CMTI", "bold-italic"), "cmcsc": ("OT1", "normal"), "cmss": ("CMSS", "sans-serif"), "cmssbx": ("CMSS", "bold-sans-serif"),
    "cmssi": ("CMSS", "sans-serif-italic"), "cmssdc": ("CMSS", "sans-serif"), "cmtt": ("OT1TT", "monospace"), "cmsltt": ("OT1TT", "monospace"),
    "cmitt": ("OT1TT", "monospace"), "cmvtt": ("OT1TT", "monospace"), "cmu": ("CMTI", "italic"), "cmdunh": ("OT1", "normal"), "cmff": ("OT1", "normal"),
    "cmfi": ("CMTI", "italic"), "cmfib": ("OT1", "normal"), "cminch": ("OT1", "normal"), "cmtex": ("OT1TT", "monospace"), "cmmi": ("OML", "italic"),
    "cmmib": ("OML", "bold-italic"), "cmsy": ("OMS", "normal"), "cmbsy": ("OMS", "bold"), "cmex": ("OMX", "normal"), "msam": ("AMSA", "normal"),
    "msbm": ("AMSB", "double-struck"), "lasy": ("LASY", "normal"), "lasyb": ("LASY", "bold"), "eufm": ("EUFRAK", "fraktur"), "eufb": ("EUFRAK", "bold-fraktur"),
    "eusm": ("OMS", "script"), "eusb": ("OMS", "bold-script"), "euex": ("OMX", "normal"), "cmmi_b": ("OML", "bold-italic"), "lmr": ("OT1", "normal"),
    "lmbx": ("OT1", "bold"), "lmri": ("CMTI", "italic"), "lmsl": ("OT1", "italic"), "lmss": ("CMSS", "sans-serif"), "lmtt": ("OT1TT", "monospace"),
    "lmmi": ("OML", "italic"), "lmmib": ("OML", "bold-italic"), "lmsy": ("OMS", "normal"), "lmbsy": ("OMS", "bold"), "lmex": ("OMX", "normal"),
}
#: Long names of Latin Modern: family.
LM_LONG = {
    "lmroman": "lmr", "lmromanslant": "lmsl", "lmromandemi": "lmbx", "lmsans": "lmss", "lmsansquot": "lmss", "lmmono": "lmtt", "lmmonoslant": "lmtt",
    "lmmonoprop": "lmtt", "lmmathitalic": "lmmi", "lmmathsymbols": "lmsy", "lmmathextension": "lmex", "lmromancaps": "lmr", "lmromanunsl": "lmr", "lmromandunh": "lmr",
}
#: Character: LaTeX command.
LATEX = {
    "ℑ": "\\Im", "ℜ": "\\Re", "ℵ": "\\aleph", "⟨": "\\langle", "⟩": "\\rangle", "≈": "\\approx", "↔": "\\leftrightarrow", "↕": "\\updownarrow",
    "⇔": "\\Leftrightarrow", "⇕": "\\Updownarrow", "⇓": "\\Downarrow", "⇐": "\\Leftarrow", "⇒": "\\Rightarrow", "⇑": "\\Uparrow", "↓": "\\downarrow", "←": "\\gets",
    "↗": "\\nearrow", "↖": "\\nwarrow", "→": "\\to", "↘": "\\searrow", "↙": "\\swarrow", "↑": "\\uparrow", "∗": "\\ast", "∖": "\\backslash", "‖": "\\|",
    "∙": "\\bullet", "⌈": "\\lceil", "⌉": "\\rceil", "©": "\\bigcirc", "⊘": "\\oslash", "⊙": "\\odot", "⊖": "\\ominus", "⊗": "\\otimes", "⊕": "\\oplus",
    "♣": "\\clubsuit", "∐": "\\amalg", "†": "\\dagger", "‡": "\\ddagger", "♢": "\\diamondsuit", "⋄": "\\diamond", "÷": "\\div", "∈": "\\in", "∅": "\\emptyset",
    "≡": "\\equiv", "≍": "\\asymp", "∃": "\\exists", "⌊": "\\lfloor", "⌋": "\\rfloor", "≻": "\\succ", "⪰": "\\succeq", "≥": "\\ge", "≫": "\\gg", "♡": "\\heartsuit",
    "∞": "\\infty", "∫": "\\smallint", "∩": "\\cap", "⊓": "\\sqcap", "⊤": "\\top", "≤": "\\le", "≪": "\\ll", "∧": "\\land", "¬": "\\neg", "∨": "\\lor",
    "↦": "\\mapstochar", "∓": "\\mp", "×": "\\times", "∇": "\\nabla", "̸": "\\not", "◦": "\\circ", "∋": "\\ni", "¶": "\\mathparagraph", "⋅": "\\cdot", "⊥": "\\bot",
    "±": "\\pm", "≺": "\\prec", "⪯": "\\preceq", "′": "\\prime", "⊂": "\\subset", "⊃": "\\supset", "∝": "\\propto", "⊆": "\\subseteq", "⊇": "\\supseteq",
    "§": "\\mathsection", "∼": "\\sim", "≃": "\\simeq", "♠": "\\spadesuit", "⊑": "\\sqsubseteq", "⊒": "\\sqsupseteq", "△": "\\triangle", "▽": "\\bigtriangledown",
    "⊢": "\\vdash", "⊣": "\\dashv", "∪": "\\cup", "⊎": "\\uplus", "⊔": "\\sqcup", "∀": "\\forall", "≀": "\\wr", "α": "\\alpha", "↩": "\\lhook", "↪": "\\rhook",
    "↽": "\\leftharpoondown", "↼": "\\leftharpoonup", "⇁": "\\rightharpoondown", "⇀": "\\rightharpoonup", "β": "\\beta", "χ": "\\chi", "δ": "\\delta", "ı": "\\imath",
    "ȷ": "\\jmath", "ε": "\\varepsilon", "ϵ": "\\epsilon", "η": "\\eta", "♭": "\\flat", "γ": "\\gamma", "ι": "\\iota", "κ": "\\kappa", "λ": "\\lambda", "ℓ": "\\ell",
    "μ": "\\mu", "♮": "\\natural", "ν": "\\nu", "ω": "\\omega", "∂": "\\partial", "ϕ": "\\phi", "φ": "\\varphi", "π": "\\pi", "ϖ": "\\varpi", "ψ": "\\psi",
    "ρ": "\\rho", "ϱ": "\\varrho", "♯": "\\sharp", "σ": "\\sigma", "ς": "\\varsigma", "⋆": "\\star", "τ": "\\tau", "θ": "\\theta", "ϑ": "\\vartheta",
    "◁": "\\triangleleft", "▷": "\\triangleright", "υ": "\\upsilon", "℘": "\\wp", "ξ": "\\xi", "ζ": "\\zeta", "⨀": "\\bigodot", "⨂": "\\bigotimes", "⨁": "\\bigoplus",
    "∮": "\\ointop", "⋂": "\\bigcap", "⋀": "\\bigwedge", "⋁": "\\bigvee", "∏": "\\prod", "∑": "\\sum", "⨄": "\\biguplus", "⨆": "\\bigsqcup", "⋃": "\\bigcup",
    "Δ": "\\Delta", "Γ": "\\Gamma", "Λ": "\\Lambda", "Ω": "\\Omega", "Φ": "\\Phi", "Π": "\\Pi", "Ψ": "\\Psi", "Σ": "\\Sigma", "Θ": "\\Theta", "Υ": "\\Upsilon",
    "Ξ": "\\Xi", "↺": "\\circlearrowleft", "⇆": "\\leftrightarrows", "⇄": "\\rightleftarrows", "↢": "\\leftarrowtail", "↣": "\\rightarrowtail", "⇚": "\\Lleftarrow",
    "⇛": "\\Rrightarrow", "∵": "\\because", "≬": "\\between", "Ⓢ": "\\circledS", "⊛": "\\circledast", "≗": "\\circeq", "⊚": "\\circledcirc", "↻": "\\circlearrowright",
    "∁": "\\complement", "↫": "\\looparrowleft", "↬": "\\looparrowright", "⇊": "\\downdownarrows", "↞": "\\twoheadleftarrow", "↠": "\\twoheadrightarrow",
    "⇇": "\\leftleftarrows", "⇉": "\\rightrightarrows", "⇈": "\\upuparrows", "≜": "\\triangleq", "◆": "\\blacklozenge", "≏": "\\bumpeq", "∔": "\\dotplus",
    "⋎": "\\curlyvee", "≒": "\\fallingdotseq", "≓": "\\risingdotseq", "⋟": "\\curlyeqsucc", "⪖": "\\eqslantgtr", "⪕": "\\eqslantless", "⋞": "\\curlyeqprec",
    "≑": "\\doteqdot", "≽": "\\succcurlyeq", "≿": "\\succsim", "⊩": "\\Vdash", "⊪": "\\Vvdash", "⋔": "\\pitchfork", "⌢": "\\smallfrown", "≎": "\\Bumpeq",
    "⪌": "\\gtreqqless", "≧": "\\geqq", "⋛": "\\gtreqless", "⪆": "\\gtrapprox", "⩾": "\\geqslant", "≷": "\\gtrless", "≳": "\\gtrsim", "⇃": "\\downharpoonleft",
    "⇂": "\\downharpoonright", "⇋": "\\leftrightharpoons", "↿": "\\upharpoonleft", "↾": "\\upharpoonright", "⊺": "\\intercal", "⋒": "\\Cap", "⪋": "\\lesseqqgtr",
    "≦": "\\leqq", "⋚": "\\lesseqgtr", "⪅": "\\lessapprox", "⩽": "\\leqslant", "≶": "\\lessgtr", "≲": "\\lesssim", "∡": "\\measuredangle", "⋙": "\\ggg", "⋘": "\\lll",
    "⊸": "\\multimap", "⋋": "\\leftthreetimes", "⋌": "\\rightthreetimes", "⊼": "\\barwedge", "⊻": "\\veebar", "⩞": "\\doublebarwedge", "≼": "\\preccurlyeq",
    "≾": "\\precsim", "‵": "\\backprime", "≌": "\\backsimeq", "∽": "\\backsim", "≖": "\\eqcirc", "⊨": "\\vDash", "↰": "\\Lsh", "↱": "\\Rsh", "⌣": "\\smallsmile",
    "∢": "\\sphericalangle", "□": "\\square", "⊡": "\\boxdot", "⊟": "\\boxminus", "⊠": "\\boxtimes", "⊞": "\\boxplus", "■": "\\blacksquare",
    "↭": "\\leftrightsquigarrow", "↝": "\\rightsquigarrow", "⋐": "\\Subset", "⫅": "\\subseteqq", "⋑": "\\Supset", "⫆": "\\supseteqq", "∴": "\\therefore",
    "▼": "\\blacktriangledown", "⊴": "\\unlhd", "◀": "\\blacktriangleleft", "⊵": "\\unrhd", "▶": "\\blacktriangleright", "▲": "\\blacktriangle", "⋓": "\\Cup",
    "⋏": "\\curlywedge", "ϝ": "\\digamma", "Ⅎ": "\\Finv", "⅁": "\\Game", "≊": "\\approxeq", "↶": "\\curvearrowleft", "↷": "\\curvearrowright", "∣": "\\shortmid",
    "ℶ": "\\beth", "ℸ": "\\daleth", "⋇": "\\divideontimes", "╲": "\\diagdown", "϶": "\\backepsilon", "≂": "\\eqsim", "⪺": "\\succnapprox", "⪶": "\\succneqq",
    "⋩": "\\succnsim", "⪸": "\\succapprox", "ℷ": "\\gimel", "⋗": "\\gtrdot", "⪊": "\\gnapprox", "⪈": "\\gneq", "≩": "\\gneqq", "⋧": "\\gnsim", "⋖": "\\lessdot",
    "⪉": "\\lnapprox", "⪇": "\\lneq", "≨": "\\lneqq", "⋦": "\\lnsim", "⋉": "\\ltimes", "⋊": "\\rtimes", "≇": "\\ncong", "↮": "\\nleftrightarrow", "↚": "\\nleftarrow",
    "↛": "\\nrightarrow", "∤": "\\nmid", "⇎": "\\nLeftrightarrow", "⇍": "\\nLeftarrow", "⇏": "\\nRightarrow", "∄": "\\nexists", "⊁": "\\nsucc", "⋡": "\\nsucceq",
    "⊮": "\\nVdash", "⊯": "\\nVDash", "≯": "\\ngtr", "≱": "\\ngeq", "≮": "\\nless", "≰": "\\nleq", "∦": "\\nparallel", "⊀": "\\nprec", "⋠": "\\npreceq",
    "⊭": "\\nvDash", "≁": "\\nsim", "⊈": "\\nsubseteq", "⊊": "\\varsubsetneq", "⊉": "\\nsupseteq", "⊋": "\\varsupsetneq", "⋬": "\\ntrianglelefteq",
    "⋭": "\\ntrianglerighteq", "⋪": "\\ntriangleleft", "⋫": "\\ntriangleright", "⊬": "\\nvdash", "∥": "\\shortparallel", "ℏ": "\\hslash", "⪹": "\\precnapprox",
    "⪵": "\\precneqq", "⋨": "\\precnsim", "⪷": "\\precapprox", "⫋": "\\subsetneqq", "⫌": "\\supsetneqq", "╱": "\\diagup", "⊲": "\\lhd", "⊳": "\\rhd", "℧": "\\mho",
    "⋈": "\\Join", "◊": "\\Diamond", "⇝": "\\leadsto", "⊏": "\\sqsubset", "⊐": "\\sqsupset",
}
# fmt: on
