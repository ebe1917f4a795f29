"""Phrase lists, term lists and labelled patterns of the audits."""

# Words that carry no content, for repeated trigrams and for content vectors.
STOPWORDS = set("a an and are as at be been by for from has have in is it of on or that the their this to was were which with".split())
VECTOR_STOPWORDS = set("a an and are as at be been being by for from had has have in into is it its of on or that the their there these this those to was were which with within without we our they them".split())
ZH_FUNCTION = "的了和与及在对为是将可由中上下一其并而或以于"
ZH_VECTOR_FUNCTION = "的了和与及在对为是将可由中上下一其并而或以于也把被所这那更后前"

# Stock phrases.
STOCK_EN = (
    ("it is important to note", r"\bit is important to note\b"), ("it should be noted that", r"\bit should be noted that\b"),
    ("it is worth noting that", r"\bit is worth noting that\b"), ("in today's rapidly evolving", r"\bin today['’]s rapidly evolving\b"),
    ("in the ever-evolving", r"\bin the ever[- ]evolving\b"), ("with the rapid development of", r"\bwith the rapid development of\b"),
    ("against the backdrop of", r"\bagainst the backdrop of\b"), ("plays a crucial role", r"\bplays? a crucial role\b"),
    ("plays a pivotal role", r"\bplays? a pivotal role\b"), ("a wide range of", r"\ba wide range of\b"),
    ("delve into", r"\bdelv(?:e|es|ed|ing) into\b"), ("multifaceted", r"\bmultifaceted\b"),
    ("underscores the importance", r"\bunderscores? the importance\b"), ("this study aims to", r"\bthis (?:study|paper|article) aims? to\b"),
    ("the findings reveal that", r"\bthe findings? (?:reveal|reveals|show|shows) that\b"), ("it can be seen that", r"\bit can be seen that\b"),
    ("in conclusion", r"\bin conclusion\b"), ("not only ... but also", r"\bnot only\b.{0,160}?\bbut also\b"),
)
STOCK_ZH = (
    ("值得注意的是", "值得注意的是"), ("需要指出的是", "需要指出的是"), ("不可否认的是", "不可否认的是"), ("随着……不断发展", "随着.{0,24}(?:不断|快速|迅速)?发展"),
    ("在……背景下", "在.{0,24}背景下"), ("具有重要意义", "具有(?:重要|深远|重大的?)(?:理论|现实|实践|学术)?意义"),
    ("发挥着至关重要的作用", "发挥着?(?:至关重要|重要|关键)的作用"), ("本文旨在", "(?:本文|本研究|本论文)旨在"), ("研究结果表明", "(?:研究|实验|分析)?结果表明"),
    ("综上所述", "综上所述"), ("一方面……另一方面", "一方面.{0,120}?另一方面"), ("不仅……而且", "不仅.{0,120}?(?:而且|还|也)"),
    ("多维度", "多维度"), ("全方位", "全方位"), ("赋能", "赋能"), ("深刻揭示", "深刻揭示"),
)

# Transitions, hedges and boosters.
TERMS_EN = {
    "transitions": ("however", "therefore", "moreover", "furthermore", "additionally", "consequently", "nevertheless", "nonetheless", "overall", "in contrast", "in addition", "on the other hand"),
    "hedges": ("may", "might", "could", "possibly", "perhaps", "likely", "appears", "suggests", "approximately", "generally", "relatively", "partly"),
    "boosters": ("clearly", "obviously", "undoubtedly", "certainly", "always", "never", "proves", "demonstrates", "definitively"),
}
TERMS_ZH = {
    "transitions": ("然而", "因此", "此外", "同时", "从而", "进而", "总体而言", "另一方面", "相比之下", "综上"),
    "hedges": ("可能", "或许", "似乎", "大致", "一定程度上", "相对", "通常", "倾向于", "有望"),
    "boosters": ("显然", "毫无疑问", "必然", "充分证明", "完全", "始终", "从不", "极其"),
}

# Lists of three.
TRIAD_ZH = r"[^，。；：!?！？、]{1,20}、[^，。；：!?！？、]{1,20}(?:、|以及|和|及|与)[^，。；：!?！？、]{1,24}"
TRIAD_EN = r"\b[^,;.!?]{1,55},\s+[^,;.!?]{1,55},\s+(?:and|or)\s+[^,;.!?]{1,55}"

# Units that belong to a number.
UNITS = (
    "mmol/L", "mol/L", "mg/dL", "ng/mL", "µg/mL", "μg/mL", "kg/m2", "kg/m²", "kHz", "MHz", "mmHg", "bpm", "mL", "µL", "μL", "ms", "min", "Hz",
    "kPa", "Pa", "°C", "kg", "mg", "ng", "µg", "μg", "mm", "cm", "km", "mol", "mmol", "L", "g", "m", "s", "h", "K",
)

# Stance markers.
NEGATION = {"en": ("neither", "without", "never", "none", "not", "no", "nor"), "zh": ("并非", "不能", "不会", "没有", "从未", "未曾", "无", "未", "不")}
MODALITY = {"en": ("might", "could", "would", "should", "must", "shall", "may", "can"), "zh": ("可能", "或许", "也许", "可以", "应该", "应当", "必须", "将会", "将", "可")}
CAUSAL = {
    "en": (
        "resulted in", "results in", "result in", "led to", "leads to", "lead to", "associating with", "associated with", "associates with", "associate with",
        "preventing", "prevented", "prevents", "prevent", "producing", "produced", "produces", "produce", "causing", "caused", "causes", "cause", "due to", "because",
    ),
    "zh": ("导致", "引起", "造成", "使得", "由于", "因为", "因此"),
}

# Phrases of the older lock.
TEMPLATES = (
    "值得注意的是", "不难发现", "综上所述", "毋庸置疑", "不可否认", "随着社会的发展", "随着科技的发展", "具有重要意义", "提供了新的思路", "首先", "其次", "最后",
    "it is worth noting", "it should be noted", "needless to say", "in today's rapidly evolving", "with the rapid development of", "plays a crucial role",
    "provides new insights into", "moreover", "furthermore", "in conclusion",
)

# What an editing process leaves behind.
RESIDUE = (
    ("原稿", "原稿"), ("修订稿", "修订稿"), ("待作者补充可核验来源", "待作者补充可核验来源"), ("待作者确认", "待作者确认"),
    ("supplied manuscript", r"\bsupplied manuscript\b"), ("supplied text", r"\bsupplied text\b"), ("supplied account", r"\bsupplied account\b"),
    ("account reviewed here", r"\baccount reviewed here\b"), ("source required", r"\bsource required\b"), ("chat-style", r"\bchat[- ]style\b"),
    ("interface residue", r"\binterface residue\b"), ("regenerate response", r"\bregenerate response\b"),
)
PLACEHOLDERS = (r"【[^】]*(?:待作者补充|来源|引用)[^】]*】", r"\[(?:SOURCE REQUIRED|CITATION NEEDED|REFERENCE NEEDED)[^\]]*\]")

# Rhetorical moves of the revision gate.
MOVES = {
    "zh": {
        "claim": "研究|观察|结果|资料|证据|提示|报告|提出|相关|联系|关联|显示|表明|发现",
        "boundary": "不能|不足以|不宜|不等同|尚未|尚不能|难以|限制|混杂|异质|间接|不确定|未必|不应|无法|不支持|不能替代|不能证明",
        "recommendation": r"需要|应当|应该|应\b|必须|后续|未来研究|研究应|分析应|试验应|至少应|优先",
    },
    "en": {
        "claim": r"\b(?:stud(?:y|ies)|research|evidence|observ(?:e|ed|ation|ations)|report(?:ed|s)?|propos(?:e|ed|es)|associat(?:e|ed|es|ion|ions)|link(?:ed|s)?|suggest(?:ed|s)?|show(?:ed|s)?|found)\b",
        "boundary": r"\b(?:cannot|does not|do not|not equivalent|should not|remain(?:s|ed)? uncertain|limit(?:ed|ation|ations)?|confound(?:ing|ed|er|ers)?|indirect|not establish|not support|without qualification|misclassification|overfit|not interchangeable|does not identify)\b",
        "recommendation": r"\b(?:should|need(?:s|ed)? to|requir(?:e|es|ed)|must|future (?:work|studies|research)|prioriti[sz]e|development requires)\b",
    },
}

# Rhetorical moves and frames of the texture audit, a larger table than the gate's.
TEXTURE_MOVES = {
    "zh": {
        "claim": "研究|观察|结果|资料|证据|提示|报告|提出|相关|联系|关联|显示|表明|发现|可见|支持",
        "boundary": "不能|不足以|不宜|不等于|尚未|尚不能|难以|限制|混杂|异质|间接|不确定|未必|不应|无法|不支持|不能替代|不能证明|边界|外推",
        "recommendation": "需要|应当|应该|必须|后续|未来研究|研究应|分析应|试验应|至少应|优先|值得检验|可检验",
    },
    "en": {
        "claim": r"\b(?:stud(?:y|ies)|research|evidence|observ(?:e|ed|ation|ations)|report(?:ed|s)?|propos(?:e|ed|es)|associat(?:e|ed|es|ion|ions)|link(?:ed|s)?|suggest(?:ed|s)?|show(?:ed|s)?|found|support(?:ed|s)?)\b",
        "boundary": r"\b(?:cannot|does not|do not|not equivalent|should not|remain(?:s|ed)? uncertain|limit(?:ed|ation|ations)?|confound(?:ing|ed|er|ers)?|indirect|not establish|not support|without qualification|misclassification|overfit|not interchangeable|does not identify|boundar(?:y|ies)|inference)\b",
        "recommendation": r"\b(?:should|need(?:s|ed)? to|requir(?:e|es|ed)|must|future (?:work|studies|research)|prioriti[sz]e|development requires|needs? validation)\b",
    },
}
CORRECTIVE = {
    "zh": "不能|不等于|并不|不是|而不是|不应|不宜|不足以|尚未|尚不能|无法|未必|不代表|只有[^。！？]{0,60}才|并非|不可",
    "en": r"\b(?:cannot|does not|do not|should not|is not|are not|was not|were not|not equivalent|not interchangeable|rather than|without|doesn't|don't|not merely)\b",
}
META = {
    "zh": (
        ("作者判断", "作者判断"), ("本节判断", "本节(?:的)?(?:判断|结论|推断)"), ("本章判断", "本章(?:的)?(?:判断|结论|推断)"), ("本文判断", "本文(?:的)?(?:判断|结论|认为)"),
        ("判断标准", "判断标准"), ("有界结论", "有界结论"), ("证据身份", "证据身份"), ("最大可支持推断", "最大可支持推断"), ("转化边界", "转化边界"), ("本节较直接的推断", "本节较直接的推断"),
        ("本节的结论", "本节的结论"), ("最稳妥的角色/判断", "最稳妥的(?:角色|判断|结论)"), ("章节自指", "(?:免疫|血管|中枢|技术|皮肤|神经|疾病|方法|干预|转化)章节"),
    ),
    "en": (
        ("author judgement", r"\bauthor judg(?:e)?ment\b"), ("central judgement", r"\bcentral judg(?:e)?ment\b"), ("resulting judgement", r"\bresulting judg(?:e)?ment\b"),
        ("bounded synthesis", r"\bbounded synthesis\b"), ("defensible inference", r"\bdefensible inference\b"), ("therapeutic boundary", r"\btherapeutic boundar(?:y|ies)\b"),
        ("clinical boundary", r"\bclinical boundar(?:y|ies)\b"), ("for this review", r"\bfor this review\b"), ("this review uses", r"\bthis review uses\b"),
        ("correct interpretation", r"\bcorrect interpretation\b"), ("maximum inference", r"\bmaximum inference\b"), ("the priority is", r"\bthe priority is\b"), ("proper ending", r"\bproper ending\b"),
        ("chapter self-reference", r"\b(?:vascular|immune|protein|disease|methods?|therapeutic|precision|sleep|glymphatic) chapter\b"),
    ),
}
CLOSURE = {
    "zh": "判断|结论|边界|优先|证据身份|最稳妥|作者|本节|本章|本文|因此|由此|当前|现阶段",
    "en": r"\b(?:judg(?:e)?ment|conclusion|boundar(?:y|ies)|priority|inference|for this review|the .* chapter|therefore|thus|the role|the central|the resulting|the defensible)\b",
}

# Section titles.
ABSTRACT = ("abstract", "摘要")
REFERENCES = ("reference", "references", "参考文献", "来源核验", "source-verification")
CONCLUSION = ("conclusion", "future directions", "结论", "未来方向")

# Number grammars of the two locks.
SIGN, INTEGER = r"[+\-\x{2212}]?", r"(?:\p{Nd}{1,3}(?:,\p{Nd}{3})+|\p{Nd}+)"
NUMBER = rf"{SIGN}(?:{INTEGER}(?:\.\p{{Nd}}+)?|\.\p{{Nd}}+)(?:[eE]{SIGN}\p{{Nd}}+)?"
PROBABILITY = rf"[pP]\s*(?:=|<|>|≤|≥)\s*{NUMBER}"
GUARD_NUMBER = (
    r"(?U)(?<![\w.])[+-]?(?:\p{Nd}{1,3}(?:,\p{Nd}{3})+|\p{Nd}+)(?:\.\p{Nd}+)?(?:\s*(?:%|‰|°[CF]?|[A-Za-zµμ][A-Za-z0-9µμ°/^·-]*|岁|年|月|日|人|例|次|组|个|项|只))?"
)

# Citations of the older lock, and identifiers.
GUARD_CITATIONS = (
    r"\[(?:\s*\p{Nd}+\s*(?:[-–,]\s*\p{Nd}+\s*)*)\]", r"\([^()\n]{0,100}(?:19|20)\p{Nd}{2}[a-z]?[^()\n]{0,50}\)", r"（[^（）\n]{0,100}(?:19|20)\p{Nd}{2}[a-z]?[^（）\n]{0,50}）",
    r"(?iU)\b10\.\d{4,9}/[-._;()/:A-Za-z0-9]+\b", r"(?iU)\bPMID\s*:?\s*\d+\b", r"(?iU)\b(?:NCT|ChiCTR)[A-Za-z0-9-]+\b",
)
DOI = r"""(?iU)(?<!\w)10\.\d{4,9}/[^\s<>"']+"""
URL = r"""(?iU)https?://[^\s<>"']+"""
