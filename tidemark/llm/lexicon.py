"""Fixed values of sentence segmentation: lists by language, in natural order."""

#: Abbreviations that a name or a number follows: their stop never ends a sentence.
BEFORE_NAME = frozenset(
    """dr prof mr mrs ms mt st gov sen rep gen col maj capt cmdr adm lt sgt cpl pvt rev msgr hon pres amb atty dept supt messrs mme mlle mm me mgr sr sra srta dª d dña
    fr hr frl ing dipl mag sta sto ste pte ave
    проф акад доц г-н г-жа тов св ул пр пл пер бул наб им
    डॉ श्री प्रो पं सुश्री
    د أ م""".split()
)
#: Abbreviations before a figure: their stop ends a sentence unless a figure follows.
BEFORE_NUMBER = frozenset("jan feb mar apr jun jul aug sep sept oct nov dec no nos nr fig figs p pp pg pág págs art vol ch sec eq para д стр рис табл п с кв корп ص पृ सं".split())
#: Abbreviations inside a clause: their stop never ends a sentence.
INSIDE = frozenset("i.e e.g a.k.a cf vs viz ca approx d.h z.b u.a p.ej p.ex bzw sog ggf inkl zzgl т.е т.к т.н напр ср ee.uu ee".split())
#: Abbreviations that may close a sentence: their stop ends one where a sentence may open next.
MAY_END = frozenset("etc inc ltd co corp llc plc s.a s.l s.a.s a.m p.m usw usf jr ph.d b.c a.d u.s u.k т.д т.п др г гг в вв тыс млн млрд руб коп".split())

MONTHS_DE = frozenset("januar jänner februar märz april mai juni juli august september oktober november dezember".split())

#: Thai: words that open a sentence, words that close one, and words that carry on with a figure.
THAI_OPEN = "คุณ ทำไม ตั้งแต่ ชาว เมื่อ แต่ และ แล้ว ดังนั้น อย่างไรก็ตาม นอกจากนี้ เพราะ ถ้า หาก ใน ที่ผ่านมา เขา เธอ ผม ฉัน เรา พวกเขา นาย นาง นางสาว ดร. ศาสตราจารย์ รัฐบาล บริษัท".split()
THAI_CLOSE = "ครับ ค่ะ คะ นะ จ้ะ จ้า แล้ว เลย มานาน บาท ปิด ด้วย อีก ไหม หรือไม่ หรือ ล่ะ สิ".split()
THAI_SINCE = "ตั้งแต่ เมื่อ ใน ภายใน ก่อน หลัง จนถึง ระหว่าง ปลาย ต้น กลาง ถึง".split()
#: Thai: words that carry a sentence on after a blank or leave it open before one, and final particles that nothing follows.
THAI_JOIN = "และ หรือ แต่ เพราะ เนื่องจาก ซึ่ง ที่ อัน โดย เพื่อ ว่า กับ แก่ ของ จาก ด้วย รวมถึง รวมทั้ง ตลอดจน เช่น ได้แก่ คือ จึง ก็ ทั้งนี้ พร้อม ส่วน".split()
THAI_AHEAD = "และ หรือ แต่ เพราะ เนื่องจาก ซึ่ง ที่ โดย เพื่อ ว่า กับ แก่ ของ จาก รวมถึง รวมทั้ง ตลอดจน เช่น ได้แก่ คือ ถ้า หาก เมื่อ ใน".split()
THAI_FINAL = "ครับ ค่ะ คะ นะ จ้ะ จ้า ไหม หรือไม่ ล่ะ".split()
#: Thai: verbs; a stretch that holds one is a clause.
THAI_VERBS = """ใช้ บอก ไม่ เห็น รอ ปิด เปิด ช่วย สร้าง ให้ ทำ ตกใจ เปลี่ยน จะ ได้ เป็น มี อยู่ ไป มา คือ กล่าว พูด ถาม ตอบ คิด รู้ ต้องการ กิน ดื่ม ซื้อ ขาย
    เดิน วิ่ง นั่ง นอน อ่าน เขียน เรียน สอน ทำงาน เริ่ม จบ เกิด ตาย ชอบ รัก กลัว ประกาศ ยืนยัน พบ ต้อง
    ส่ง รับ ถึง กลับ ออก เข้า ขึ้น ลง หา เจอ จ่าย เก็บ ใส่ ถือ จับ ตัด ล้าง ซ่อม ย้าย หยุด เลือก เสนอ สนับสนุน คัดค้าน ประชุม ตัดสิน อนุมัติ
    ยกเลิก เพิ่ม ลด ขยาย พัฒนา ปรับปรุง แก้ไข ตรวจสอบ สำรวจ ศึกษา วิเคราะห์ รายงาน เผย ระบุ ชี้ เตือน ขอ เชื่อ หวัง สงสัย เข้าใจ ลืม จำ ฟัง ดู""".split()
#: Common words for the word lattice of scripts without spaces.
THAI_WORDS = """ปี พ.ศ. ล้าน บาท แสน หมื่น พัน ร้อย เปอร์เซ็นต์ ต้อง ใช้ เงิน บอก ว่า ไม่ เห็น ด้วย กับ รอ มา นาน จึง ปิด เปิด ช่วย สร้าง ปัญหา ให้ ทำ ตกใจ ทั้ง
    เปลี่ยน ชีวิต ของ เมือง บ้าน เกาะ ท่า เรือ เก่า ใหม่ กฎหมาย สะพาน ไม้ ตลาด ท้องถิ่น โรงเรียน ชนบท ที่ จะ ได้ เป็น มี อยู่ ไป การ ความ คน วัน เดือน นี้ นั้น มาก ดี""".split()
JAPANESE_WORDS = "と は が を に の で も から まで より へ や か ね よ です ます した ました でした のか と述べた と語った と尋ねた という と言った".split()
CHINESE_WORDS = "说 道 说完 说着 答道 叫道 笑道 叹道 回应 透露 强调 解释 补充 承认 警告 宣布 呼吁 坚称 评论 总结 感叹 抱怨 提醒 建议 反驳 否认 介绍 报道 声称 写 喊 笑 答 问 问道 说道 表示 认为 回答 喊道 写道 指出 告诉 称 的 了 在 是 和".split()

#: What may follow a closing quotation inside its sentence.
JAPANESE_AFTER = ("と", "って", "という", "、", "は", "が", "の", "を", "に", "も", "で")
CHINESE_SAID = ("回应", "透露", "解释", "补充", "承认", "警告", "宣布", "呼吁", "坚称", "评论", "总结", "感叹", "抱怨", "提醒", "反驳", "否认", "介绍", "声称", "叫道", "叹道", "说", "问", "道", "表示", "认为", "回答", "喊", "写", "称", "指出", "强调", "告诉", "笑", "答")
