"""Fixed values.

Everything in this file is a fixed value: word lists, lookup tables, thresholds and label vocabularies that a result
depends on. They are plain data, stated once, and every operator takes them as overridable parameters.
"""

# --- labels ---------------------------------------------------------------------------------------------------------
NO_LABEL = "không_có"
NULL_WORDS = ["nan", "None", "0", ""]
LABEL_SEPARATOR = " | "
LABEL_COLUMNS = ["product_line", "kind", "class1", "class2"]
UNCLASSIFIED = "Chưa phân loại"

# fixed values: alias -> canonical, per label level
LABEL_ALIASES = {
    "product_line": {
        "Đèn UV": "đèn uv", "đèn UV": "đèn uv", "Sp truyền thống": "SP truyền thống", "SP LEd": "SP LED",
        "SP Led": "SP LED", "sp led": "SP LED", "sp khác": "SP khác", "sp truyền thống": "SP truyền thống",
        "SP ĐÈN LED": "SP LED", "SP đèn LED": "SP LED",
    },
    "kind": {
        "nc": "NC", "lk": "LK", "Nguyên chiếc": "NC", "Linh kiện": "LK", "nguyên chiếc": "NC", "linh kiện": "LK",
        "": "không_có", "nan": "không_có", "None": "không_có", "0": "không_có",
    },
    "class1": {
        "Highbay": "highbay", "Lowbay": "lowbay", "LED khác": "led khác", "Chưa phân loại": "không_có",
        "": "không_có", "nan": "không_có", "None": "không_có", "0": "không_có",
    },
    "class2": {"Smart": "smart", "": "không_có", "nan": "không_có", "None": "không_có", "0": "không_có"},
}

# fixed values: product line by 4-digit heading, overrides by full code, names for headings outside the first map
LINE_BY_HEADING = {
    "9617": "SP BÌNH/PHÍCH", "7020": "SP THỦY TINH", "8539": "SP LED", "9405": "SP LED",
    "8516": "SP THIẾT BỊ ĐIỆN GIA DỤNG", "8504": "SP BỘ NGUỒN/BIẾN ÁP",
}
LINE_OVERRIDES = {"85394900": "đèn uv", "85394100": "đèn uv"}
LINE_BY_HEADING_OFFLINE = {
    "9617": "SP BÌNH/PHÍCH", "7020": "SP THỦY TINH", "8539": "SP ĐÈN/BÓNG ĐÈN",
    "9405": "SP ĐÈN/THIẾT BỊ CHIẾU SÁNG", "8516": "SP THIẾT BỊ ĐIỆN GIA DỤNG",
}

# --- statuses -------------------------------------------------------------------------------------------------------
STATUS_HISTORY = "auto_history"
STATUS_DICTIONARY = "auto_dictionary"
STATUS_SINGLE = "auto_single"
STATUS_MODEL = "auto_model"
STATUS_REVIEW = "review"
MODEL_THRESHOLD = 0.85
OVERLAP_THRESHOLD = 0.5
WEIGHTED_THRESHOLD = 5
MASKED_THRESHOLD = 15
OVERRIDE_CONFIDENCE = 0.8
RARE_LABEL_ROWS = 5

# fixed values: confidence bin edges of the calibration table
CALIBRATION_EDGES = [0.0, 0.5, 0.6, 0.7, 0.8, 0.85, 0.9, 0.95, 1.0]

# --- text -----------------------------------------------------------------------------------------------------------
SEGMENT_MARK = "#&"
# fixed values: letters kept by cleaning, next to a-z and 0-9
VIETNAMESE_LETTERS = "àáạảãâầấậẩẫăằắặẳẵèéẹẻẽêềếệểễìíịỉĩòóọỏõôồốộổỗơờớợởỡùúụủũưừứựửữỳýỵỷỹđ"
POWER_PATTERN = r"(\d+(?:\.\d+)?)\s*(w|watt|hp|kw|kva|v)"

# fixed values: brands, in look-up order
BRANDS = ["rạng đông", "điện quang", "panasonic", "philips", "lg", "samsung", "daikin", "sony", "toshiba", "sharp",
          "sino", "cadivi"]

# fixed values: words ignored by the word-overlap score
OVERLAP_STOPWORDS = [
    "có", "bằng", "đèn", "hàng", "mới", "100", "hiệu", "dùng", "để", "sáng", "chiếu", "của", "và", "nhựa", "bộ", "c",
    "với", "các", "loại", "cho", "1", "2", "3", "0", "led", "sản", "xuất", "bảng", "chiếc", "cái", "unk", "gp", "pce",
    "w", "v", "kg", "pcs", "set", "thùng", "hộp", "bao", "gói", "bóng", "quang", "điện", "hoạt", "động", "ống", "nước",
    "thông", "minh", "kích", "thước", "màu", "sắc", "chất", "liệu", "sử", "dụng", "dẫn",
]

# fixed values: general stop words
TEXT_STOPWORDS = [
    "của", "và", "các", "có", "là", "được", "cho", "trong", "với", "không", "những", "một", "từ", "cùng", "khi", "đó",
    "thì", "ở", "đến", "này", "bằng", "theo", "như", "tại", "vào", "phải", "về", "lại", "thêm", "ra", "nếu", "hơn",
    "chưa", "nên", "vẫn", "để", "mà", "sau", "nào", "chỉ", "loại", "hiệu", "mới", "dùng", "tên", "chi", "tiết", "hàng",
    "nhãn", "model", "mã", "số", "sản", "phẩm", "kích", "thước", "xuất", "khẩu", "nhập", "nsx", "ltd", "co", "corp",
    "inc", "company", "brand", "new", "the", "for", "and", "vn", "cn", "100", "hàng mới", "mới 100", "us", "uk", "kr",
    "jp", "de", "fr", "it", "au", "ca", "eu", "stanley", "owala", "zojirushi", "lock", "locknlock", "tupperware",
    "fuji", "tyeso", "outin", "elemental", "cherry", "mkb", "mkr", "mcs", "mcz", "mct", "med", "btl", "sb", "pcs",
    "set", "unit", "pc", "oz", "ml", "mm", "cm", "made", "use", "size", "type", "part",
]

# fixed values: further stop words when tokens become label keywords
LABEL_ONLY_STOPWORDS = [
    "chất", "liệu", "thể", "điện", "ngoài", "bên", "lớp", "thương", "cách", "giữa", "tích", "hoàn", "chỉnh", "gồm",
    "kết", "hợp", "mặt", "tổng", "dòng", "đặc", "chuyên", "thông", "dụng", "đầu", "trên", "dưới", "trước", "trong",
    "ký", "đê", "phân", "phối", "nhà", "làm", "đang", "quốc", "mbình", "cao", "dài", "rộng", "dày", "mỏng", "nhỏ",
    "lớn", "đơn", "kép", "đen", "trắng", "xám", "xanh", "đỏ", "vàng", "hồng", "tím", "nâu", "bạc", "ngà", "sẫm",
    "nhạt", "đậm", "màu", "sắc", "oz", "ml", "lít", "lit", "liter", "litre", "g", "kg", "w", "v", "watt", "volt", "wh",
    "kwh", "ac", "dc", "mới100", "hiêu", "slo", "quy", "kiểu", "khôngcó", "thươnghiệu", "khônghiệu", "bìnhgiữnhiệt",
    "chấtliệubằngthépkhôngrỉ", "dungtích", "vỏbằng", "vacuum", "steel", "stainless", "bottle", "cup", "mug", "thermos",
    "body", "lid", "cap", "inner", "outer", "bottom", "clear", "logo", "food", "grade", "bpa", "free", "with",
    "without", "double", "wall", "flask", "tumbler", "water", "insulated", "travel", "handle", "worthington",
    "dachengco", "wolfpak", "kaxifei", "shandongco", "lebenlang", "qihu", "lhc", "vhc", "commerce", "containers",
    "serial", "allcho", "kaiyo", "ruby", "elk", "products", "guangzhou", "zhejiang", "industry", "main", "huizhou",
    "revomax", "dwf", "tresette", "zhengzheng", "shang", "shengyuan", "inochi", "ember", "xile", "hoycom", "adventure",
    "quencher", "rna", "tumb", "qnchr", "hankie", "urban", "outfitters", "sprngblssms", "nonvac", "disney", "sports",
    "ky", "dt", "rb", "db", "wd", "wt", "th", "psg", "ign", "ptr", "hsymbl", "hsty", "ctg", "mcx", "mea", "mtr",
]
LABEL_STOPWORDS = TEXT_STOPWORDS + LABEL_ONLY_STOPWORDS

# fixed values: words that never make a keyword
KEYWORD_STOPWORDS = ["hiệu", "công suất", "kích thước", "jindian", "philips", "gp", "rạng đông", "điện quang",
                     "panasonic", "samsung", "lg", "toshiba", "màu sắc", "bảo hành"]
KEYWORD_BONUS_TERMS = ["năng lượng mặt trời", "solar", "nlmt"]

# fixed values: terms that decide a weighted match, and terms that carry no weight in it
HIGH_VALUE_TERMS = [
    "năng lượng mặt trời", "nlmt", "bán nguyệt", "tuýp bán nguyệt", "âm trần", "đèn âm trần", "âm nước",
    "đèn âm nước", "mắt cáo", "rọi ray", "đèn rọi ray", "ống bơ", "ốp trần", "gắn tường", "đèn tường", "đội đầu",
    "đèn pin", "diệt côn trùng", "bắt muỗi", "ngoài trời", "cảnh quan", "sân vườn", "bảng hiệu", "soi bảng",
    "biển quảng cáo", "nhà xưởng", "nhà máy", "đánh cá", "câu mực", "bàn thờ", "trang trí", "thoát hiểm", "sự cố",
    "khẩn cấp", "panel", "đèn panel", "đèn chùm", "đèn thả", "dây led", "led cuộn", "thanh", "hồng ngoại", "cảm biến",
    "tuýp", "bulb", "tube", "bàn", "cực tím", "halogen", "cháy", "nổ", "dây", "uv", "phát quang", "ufo",
    "công nghiệp", "highbay", "lowbay", "flood", "pha", "downlight", "spotlight", "tracklight", "đường phố",
]
JUNK_TERMS = [
    "chiếu sáng", "mới", "100", "hàng mới 100", "hàng mới", "hàng", "chính hãng", "chi tiết", "bộ phận", "công suất",
    "kích thước", "điện áp", "chất liệu", "nhôm", "nhựa", "hoạt động", "nsx", "co", "ltd", "industrial", "factory",
    "zhejiang", "zhongshan", "mới 100", "model", "dạng", "loại",
]
# the masking variant spells one term in capitals, which lower-cased text never contains, and has four more junk terms
MASKED_HIGH_VALUE_TERMS = [t for t in HIGH_VALUE_TERMS if t != "ufo"]
MASKED_JUNK_TERMS = JUNK_TERMS + ["có", "led", "đèn led", "đèn"]

# fixed values: words that mark a component
COMPONENT_TERMS = ["bộ phận", "linh kiện", "phụ tùng", "phụ kiện", "nắp", "vỏ", "lõi", "ruột", "đui", "chấn lưu",
                   "driver", "mạch", "module", "mô-đun", "điện trở", "tấm", "khung", "đế", "ống", "khuôn"]

# --- columns --------------------------------------------------------------------------------------------------------
# fixed values: accepted input column names, in order of preference
DESCRIPTION_CANDIDATES = ["Detailed_Product", "Actual_Detailed_Product_LL", "Actual_Detail_Product",
                          "Actual_Detailed_Product", "Tên hàng gốc", "Description", "Mô tả", "Tên hàng", "Product"]
HS_CANDIDATES = ["HS_Code", "Mã HS", "HS Code", "Mã hàng", "HS"]
HEADER_MARKERS = ["HS_Code", "VN_Exporter", "VN_Importer", "Detailed_Product", "Actual_Detail_Product",
                  "Actual_Detailed_Product"]
PREAMBLE_LINES = 9

# fixed values: columns of the cleaned table, in order
CLEAN_COLUMNS = [
    "date", "hs_code", "importer", "product_name", "unit", "quantity", "total_value_usd", "unit_price_usd", "brand",
    "product_line", "kind", "class1", "class2", "power", "country", "continent", "purpose", "exporter", "incoterms",
    "method_of_payment", "power_2", "kind_1", "kind_2", "year", "status",
]

# Words that mark a component in the three-rule kind.
KIND_RULE_TERMS = [
    "linh kiện", "phụ tùng", "bộ phận", "nắp", "vòi", "thân", "đáy", "phôi", "gioăng", "vòng", "đệm", "vít", "ốc", "trục", "khuôn", "viền", "vỏ", "lõi",
    "tấm", "phụ kiện", "mảnh", "miếng", "nút", "đầu", "tay cầm", "ruột", "cán", "khung", "mặt nạ", "chân", "đế", "ống hút", "nút bấm", "vòng đệm", "đui",
    "chấn lưu", "driver", "pcba", "mạch", "bảng mạch", "module", "mô-đun"]
