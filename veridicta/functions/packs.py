"""Rule packs: what text counts as a sign of a topic, of an action status, or of evidence.

A pack is data: (label, rule, source, description, patterns) for scoring rules, (type, weight, patterns) for evidence.
Operators take packs as parameters.  ``SYNTHETIC_*`` fire on invented prose in en, de, fr and es.
"""

from __future__ import annotations

from typing import NamedTuple


class Rule(NamedTuple):
    label: str
    name: str
    source: str
    description: str
    patterns: tuple[str, ...]
    weight: float = 1.0


class Evidence(NamedTuple):
    name: str
    weight: float
    patterns: tuple[str, ...]


TOPICS = ("E", "S_labor", "S_community", "S_product", "G", "Non_ESG")
ESG_TOPICS = TOPICS[:5]
ACTIONS = ("Implemented", "Planning", "Indeterminate")

# Rule names, sources, descriptions and patterns of the topic and action labels.
TOPIC_RULES = (
    Rule("E", "GRI301_Materials", "GRI 301: Materials 2016", "Materials usage and recycling", (
        r"\b(nguyên vật liệu|vật liệu tái chế|tái chế|recycled material)",
        r"\b(tiêu thụ nguyên liệu|material consumption)\b",
    )),
    Rule("E", "GRI302_Energy", "GRI 302: Energy 2016", "Energy consumption, intensity, and reduction", (
        r"\b(năng lượng|energy|kWh|MWh|GWh|MW)\b",
        r"\b(tiêu thụ năng lượng|energy consumption|cường độ năng lượng)\b",
        r"\b(năng lượng tái tạo|renewable energy|điện mặt trời|solar|wind)\b",
        r"\b(tiết kiệm năng lượng|energy saving|energy efficiency)\b",
    )),
    Rule("E", "GRI303_Water", "GRI 303: Water and Effluents 2018", "Water withdrawal, consumption, and discharge", (
        r"\b(nước|water|m3|tài nguyên nước|nguồn nước)\b",
        r"\b(nước thải|wastewater|xử lý nước|water treatment)\b",
    )),
    Rule("E", "GRI305_Emissions", "GRI 305: Emissions 2016", "GHG emissions, reduction, intensity", (
        r"\b(chuyển đổi xanh|green transition|chuyển dịch năng lượng|energy transition)\b",
        r"\b(kiểm kê khí nhà kính|ghg inventory|phát thải ròng bằng không|tín chỉ carbon|carbon credit)\b",
        r"\b(khí thải|phát thải|emission|CO2|carbon|GHG)\b",
        r"\b(Scope\s*[123]|phạm vi\s*[123])\b",
        r"\b(carbon footprint|dấu chân carbon|khí nhà kính)\b",
        r"\b(net[\-\s]?zero|trung hòa carbon|carbon neutral)\b",
        r"\b(giảm phát thải|emission reduction|carbon offset)\b",
    )),
    Rule("E", "GRI306_Waste", "GRI 306: Waste 2020", "Waste generation, disposal, recycling", (
        r"\b(kinh tế tuần hoàn|circular economy|rác thải nhựa|plastic waste|vật liệu phân hủy sinh học)\b",
        r"\b(chất thải|rác thải|waste|hazardous waste)\b",
        r"\b(xử lý chất thải|waste management|waste disposal)\b",
        r"\b(ô nhiễm|pollution|contamination)\b",
    )),
    Rule("E", "GRI304_Biodiversity", "GRI 304: Biodiversity 2016", "Biodiversity impacts and conservation", (
        r"\b(đa dạng sinh học|biodiversity|hệ sinh thái|ecosystem)\b",
        r"\b(bảo tồn|conservation|rừng|forest|deforestation)\b",
    )),
    Rule("E", "Climate_Finance", "GRI 201 + TCFD Guidelines", "Green financial instruments and climate finance", (
        r"\b(khung tài chính xanh|green framework|esg loan|khoản vay xanh|tài trợ dự án xanh)\b",
        r"\b(tín dụng xanh|green credit|trái phiếu xanh|green bond)\b",
        r"\b(tài chính xanh|green finance|tài chính bền vững)\b",
        r"\b(tài chính khí hậu|climate finance)\b",
    )),
    Rule("S_labor", "GRI401_Employment", "GRI 401: Employment 2016", "Employment practices, benefits, retention", (
        r"\b(tuyển dụng|recruitment|nhân sự mới|new hires)\b",
        r"\b(phúc lợi|benefits|chế độ đãi ngộ|compensation)\b",
        r"\b(lương|salary|thu nhập|income|thưởng|bonus)\b",
    )),
    Rule("S_labor", "GRI403_OHS", "GRI 403: Occupational Health and Safety 2018", "Workplace health and safety", (
        r"\b(an toàn lao động|occupational health|safety|ATLĐ)\b",
        r"\b(sức khỏe nghề nghiệp|workplace safety)\b",
        r"\b(tai nạn lao động|work injury|incident)\b",
    )),
    Rule("S_labor", "GRI404_Training", "GRI 404: Training and Education 2016", "Employee training and development", (
        r"\b(giữ chân nhân tài|talent retention|đánh giá hiệu quả công việc|performance review|lộ trình thăng tiến)\b",
        r"\b(đào tạo|training|phát triển nhân sự|staff development)\b",
        r"\b(nâng cao năng lực|capacity building|skill)\b",
        r"\b(giờ đào tạo|training hours|chương trình đào tạo)\b",
    )),
    Rule("S_labor", "GRI405_Diversity", "GRI 405: Diversity and Equal Opportunity 2016", "Diversity, equity, and inclusion", (
        r"\b(bình đẳng giới|gender equality|đa dạng|diversity)\b",
        r"\b(nữ giới|female|phụ nữ|women in leadership)\b",
        r"\b(hòa nhập|inclusion|công bằng|equity)\b",
    )),
    Rule("S_labor", "GRI402_LaborRelations", "GRI 402: Labor/Management Relations 2016", "Labor relations and work conditions", (
        r"\b(người lao động|CBNV|cán bộ nhân viên|employee)\b",
        r"\b(quan hệ lao động|labor relations|công đoàn|union)\b",
        r"\b(môi trường làm việc|work environment|workplace)\b",
        r"\b(văn hóa doanh nghiệp|corporate culture)\b",
    )),
    Rule("S_community", "GRI413_Community", "GRI 413: Local Communities 2016", "Community engagement and social programs", (
        r"\b(cộng đồng|community|địa phương|local)\b",
        r"\b(từ thiện|charity|thiện nguyện|volunteer)\b",
        r"\b(trách nhiệm xã hội|social responsibility|CSR)\b",
        r"\b(an sinh xã hội|social welfare)\b",
        r"\b(học bổng|scholarship|quỹ xã hội|social fund)\b",
        r"\b(phát triển cộng đồng|community development)\b",
        r"\b(cứu trợ|relief|hiến máu|blood donation|tài trợ giáo dục|tài trợ y tế)\b",
    )),
    Rule("S_product", "GRI416_CustomerHealth", "GRI 416: Customer Health and Safety 2016", "Customer health and safety", (
        r"\b(bảo vệ.*khách hàng|consumer protection)\b",
        r"\b(quyền lợi khách hàng|customer rights)\b",
    )),
    Rule("S_product", "GRI417_Marketing", "GRI 417: Marketing and Labeling 2016", "Product/service marketing and labeling", (
        r"\b(minh bạch thông tin sản phẩm|product labeling)\b",
        r"\b(chất lượng dịch vụ|service quality)\b",
        r"\b(trải nghiệm khách hàng|customer experience)\b",
    )),
    Rule("S_product", "GRI418_Privacy", "GRI 418: Customer Privacy 2016", "Customer data privacy and security", (
        r"\b(bảo mật|bảo vệ dữ liệu|data protection|privacy)\b",
        r"\b(an toàn thông tin|information security|an ninh mạng|cybersecurity)\b",
        r"\b(dữ liệu cá nhân|personal data|pdpa|nddp|nghị định 13|chuẩn pci dss)\b",
    )),
    Rule("S_product", "FinancialInclusion", "SDG 8: Decent Work, SDG 10: Reduced Inequality", "Financial inclusion and literacy", (
        r"\b(tài chính toàn diện|financial inclusion)\b",
        r"\b(giáo dục tài chính|financial literacy)\b",
        r"\b(tiếp cận tài chính|access to finance)\b",
    )),
    Rule("G", "GRI205_AntiCorruption", "GRI 205: Anti-corruption 2016", "Anti-corruption policies and practices", (
        r"\b(chống tham nhũng|anti-corruption|liêm chính|integrity)\b",
        r"\b(đạo đức kinh doanh|business ethics|code of conduct)\b",
        r"\b(phòng chống rửa tiền|aml|biết khách hàng là ai|kyc|chống tài trợ khủng bố|cft)\b",
        r"\b(bảo vệ người tố giác|whistleblower|xung đột lợi ích|conflict of interest)\b",
    )),
    Rule("G", "GRI2_Governance", "GRI 2: General Disclosures 2021", "Corporate governance structure", (
        r"\b(quản trị công ty|corporate governance)\b",
        r"\b(hội đồng quản trị|board of directors|HĐQT)\b",
        r"\b(minh bạch|transparency|công bố thông tin|disclosure)\b",
        r"\b(ủy ban esg|esg committee|ban chỉ đạo esg|tích hợp esg|esg integration)\b",
    )),
    Rule("G", "RiskManagement", "GRI 2 + Basel III Framework", "Risk management and compliance", (
        r"\b(quản trị rủi ro|risk management|quản lý rủi ro)\b",
        r"\b(kiểm soát nội bộ|internal control|kiểm toán nội bộ)\b",
        r"\b(tuân thủ|compliance|quy định|regulation)\b",
    )),
    Rule("G", "Audit_Oversight", "GRI 2: General Disclosures 2021", "Audit and supervisory functions", (
        r"\b(kiểm toán|audit|giám sát|oversight|supervision)\b",
        r"\b(ban kiểm soát|supervisory board)\b",
    )),
)

ACTION_RULES = (
    Rule("Implemented", "Bloom_HighLevel_Verbs", "Anderson & Krathwohl (2001). Bloom's Taxonomy Revised [6]", "High-level cognitive verbs in past tense indicating completed actions", (
        r"\b(đã triển khai|đã thực hiện|đã hoàn thành|đã đạt được)\b",
        r"\b(đã giảm|đã tăng|đã tiết kiệm|đã cắt giảm|đã xử lý)\b",
        r"\b(hoàn thành|ghi nhận|đạt được|thực hiện được)\b",
        r"\b(triển khai thành công|vận hành|ứng dụng|áp dụng)\b",
    )),
    Rule("Implemented", "Quantitative_Results", "Florstedt, Fahlbusch & Sontheimer (2025) [4] + GRI 'Quantification Principle'", "Quantitative evidence of past performance", (
        r"(?:đã|năm \d{4}).{0,50}?\d+\s*(?:%|tỷ|triệu|nghìn|tấn|kWh|MWh|CO2|giờ)",
        r"\d+\s*(%|tỷ|triệu|nghìn|tấn|kWh|MWh).*?(so với|giảm|tăng|đạt)",
        r"trong năm (2019|2020|2021|2022|2023)\b",
        r"năm (2019|2020|2021|2022|2023)\b.*?(đạt|hoàn thành|thực hiện)",
    )),
    Rule("Planning", "Future_Commitment", "Florstedt, Fahlbusch & Sontheimer (2025) [4]", "Forward-looking statements with specific targets", (
        r"\b(sẽ|dự kiến|kế hoạch|định hướng|mục tiêu)\b",
        r"\b(hướng tới|phấn đấu|đặt mục tiêu|cam kết.*sẽ)\b",
        r"\b(triển khai trong|thực hiện trong giai đoạn)\b",
        r"(đến năm|vào năm|mục tiêu.*?năm)\s*(2025|2026|2027|2028|2029|2030|2050)\b",
        r"\b(net zero|trung hòa carbon).*?(2030|2040|2050)\b",
        r"(lộ trình|roadmap).*?(2025|2030|2050)",
    )),
    Rule("Indeterminate", "Hedging_Vagueness", "Hyland (2005). Metadiscourse [3]; Crismore et al. (1993) [5]", "Hedging markers that reduce commitment certainty", (
        r"\b(có thể|perhaps|maybe|might)\b",
        r"\b(phần nào|somewhat|to some extent)\b",
        r"\b(tương đối|relatively|fairly)\b",
        r"\b(ngày càng|không ngừng|liên tục|dần dần)\b",
        r"\b(góp phần|đóng góp vào|hỗ trợ)\b",
    )),
    Rule("Indeterminate", "Boosting_Exaggeration", "Hyland (2005). Metadiscourse [3]", "Boosting markers that amplify claims without evidence", (
        r"\b(luôn luôn|always|definitely|certainly)\b",
        r"\b(rất|highly|extremely|hoàn toàn|absolutely)\b",
        r"\b(hàng đầu|tiên phong|dẫn đầu|leading|pioneer)\b",
        r"\b(xuất sắc|outstanding|vượt trội|world-class)\b",
    )),
    Rule("Indeterminate", "Vague_Commitment_Language", "Florstedt, Fahlbusch & Sontheimer (2025) [4] — 'cheap talk' indicators", "Vague commitment language without actionable specifics", (
        r"\b(cam kết|hướng tới|tăng cường|đẩy mạnh|tiếp tục)\b",
        r"\b(chú trọng|quan tâm|ưu tiên|nỗ lực)\b",
        r"\b(phát triển bền vững|trách nhiệm xã hội)\b",
        r"\b(nâng cao nhận thức|nâng cao|cải thiện)\b",
        r"\b(đang nghiên cứu|xem xét|trong quá trình|từng bước)\b",
        r"\b(chung tay|góp sức|kêu gọi|đồng hành cùng)\b",
    )),
)

# Quantities and target years.
HAS_NUMBERS = r"\d+\s*(%|tỷ|triệu|nghìn|tấn|kg|kWh|MWh)"
FUTURE_YEAR = r"(2025|2026|2027|2028|2029|2030|2050)"

# What speaks against a completed action.
ACTION_NEGATIONS = (
    Rule("Implemented", "hedging_indicator", "Hyland (2005) Metadiscourse hedging markers", "hedge_neg_implemented", (
        r"\b(luôn|always|hướng tới|towards|nỗ lực|strive|phấn đấu)\b",
        r"\b(tiên phong|pioneering|dẫn đầu|leading|tinh thần)\b",
        r"\b(quan tâm|care about|chú trọng|focus on|cam kết|commit)\b",
    )),
    Rule("Implemented", "vague_commitment", "Vague commitment patterns -> ¬Implemented", "vague_neg_implemented", (
        r"\b(nỗ lực|cố gắng|phấn đấu|hướng tới|mong muốn)\b",
        r"\b(đóng góp vào|góp phần|thúc đẩy|đẩy mạnh)\b",
    )),
)

# Evidence types in detection order, with their weights.
EVIDENCE = (
    Evidence("Third_party", 0.35, (
        r"\b(kiểm toán|audited?|xác nhận|verified|certified)\b",
        r"\b(chứng nhận|certification|accreditation)\b",
        r"\b(đánh giá độc lập|independent assessment)\b",
        r"\b(Deloitte|PwC|KPMG|EY|Ernst\s*&\s*Young)\b",
        r"\b(Bureau Veritas|DNV|SGS)\b",
        r"\b(FiinRatings|Vietnam Credit)\b",
        r"\b(giải thưởng|award|recognition)\b",
        r"\b(top\s*\d+|ranking|xếp hạng)\b",
    )),
    Evidence("KPI", 0.30, (
        r"\d+[\.,]?\d*\s*(%|phần trăm|percent)",
        r"\d+[\.,]?\d*\s*(tỷ|triệu)\s*(đồng|VND|USD)?",
        r"\d+[\.,]?\d*\s*(tấn|kg|ton|tonnes?)\s*(CO2|carbon)?",
        r"\d+[\.,]?\d*\s*(kWh|MWh|GWh|MW)",
        r"\d+[\.,]?\d*\s*(m2|m3|ha|hecta)",
        r"\d+[\.,]?\d*\s*(người|nhân viên|CBNV|khách hàng)",
        r"(giảm|tăng|đạt|tiết kiệm|cắt giảm)\s+\d+[\.,]?\d*\s*%",
        r"(so với|compared to).*\d+",
        r"Scope\s*[123].*\d+",
    )),
    Evidence("Standard", 0.20, (
        r"\b(GRI\s*\d*|Global Reporting Initiative)\b",
        r"\b(SBTi|Science Based Targets?)\b",
        r"\b(ISO\s*\d+|ISO\s*14001|ISO\s*26000)\b",
        r"\b(SDG|Sustainable Development Goals?)\b",
        r"\b(Net[\-\s]?Zero|carbon neutral|trung hòa carbon)\b",
        r"\b(Paris Agreement|COP\d+)\b",
        r"\b(CDP|Carbon Disclosure Project)\b",
        r"\b(TCFD|Task Force on Climate)\b",
        r"\b(UN Global Compact|UNGC)\b",
        r"\b(ESG rating|xếp hạng ESG)\b",
        r"\b(Thông tư\s*\d+|Nghị định\s*\d+)\b",
        r"\b(NHNN|Ngân hàng Nhà nước)\b",
    )),
    Evidence("Time_bound", 0.15, (
        r"\b(năm|year)\s*(20\d{2})\b",
        r"\b(trong năm|in)\s*(20\d{2})\b",
        r"\b(đến|by|until)\s*(20\d{2})\b",
        r"\b(giai đoạn|period)\s*(20\d{2})\s*[-–]\s*(20\d{2})\b",
        r"\b(Q[1-4]|quý\s*[1-4IViv]+)[\/\s]*(20\d{2})\b",
        r"\b(tháng\s*\d+|month\s*\d+)[\/\s]*(20\d{2})\b",
        r"\b(trong\s+\d+\s*(năm|tháng|quý))\b",
        r"\b(mục tiêu|target)\s*(20\d{2})\b",
    )),
)

# Quantities as they are reported.
KPI_VALUES = (
    r"(\d+[\.,]?\d*\s*%)",
    r"(\d+[\.,]?\d*\s*(tỷ|triệu)\s*đồng)",
    r"(\d+[\.,]?\d*\s*(tấn|kg)\s*CO2?)",
    r"(\d+[\.,]?\d*\s*(kWh|MWh))",
)

# For invented prose: function words of four languages, digits and marks.
SYNTHETIC_TOPIC_RULES = (
    Rule("E", "en_article", "synthetic", "the, of", ("the", "of ")),
    Rule("E", "digits", "synthetic", "digits", ("[0-9]+", "[|]")),
    Rule("S_labor", "de_article", "synthetic", "der, die", ("der ", "die ")),
    Rule("S_community", "fr_article", "synthetic", "les, des", ("les ", "des ")),
    Rule("S_product", "es_article", "synthetic", "los, las", ("los ", "las ")),
    Rule("G", "with", "synthetic", "with, avec", (" with ", " avec ", " mit ", " con ")),
)
SYNTHETIC_ACTION_RULES = (
    Rule("Implemented", "ed", "synthetic", "past endings", ("ed ", "ed[.]")),
    Rule("Implemented", "numbers", "synthetic", "numbers", ("[0-9]{2,}", "[0-9]")),
    Rule("Planning", "to", "synthetic", "to, zu, pour, para", (" to ", " zu ", " pour ", " para ")),
    Rule("Indeterminate", "soft", "synthetic", "ing, ung", ("ing ", "ung ")),
    Rule("Indeterminate", "and", "synthetic", "and, und, et, y", (" and ", " und ", " et ", " y ")),
)
SYNTHETIC_EVIDENCE = (
    Evidence("Third_party", 0.35, (" by ", " von ", " par ", " por ")),
    Evidence("KPI", 0.30, ("[0-9]+", "[|]")),
    Evidence("Standard", 0.20, ("(the|die) [a-z]+tion", "ment ")),
    Evidence("Time_bound", 0.15, (" in ", " en ")),
)
SYNTHETIC_KPI_VALUES = ("([0-9]+)", "([|] [a-z]+)")
