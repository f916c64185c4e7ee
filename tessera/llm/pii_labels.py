"""The small labelled table from which the tagger for personal information is trained.

All content is invented. A row is a text with spans (start, end, kind), put together from the phrases and pools below with a fixed seed, so
the table is the same everywhere. Pools hold general shapes (made-up syllables among them), so that words the table lacks are met in training too.
"""

from __future__ import annotations

import random

KINDS = ("email", "phone", "id_number", "street_address", "name")
ROWS = 3600

GIVEN = """Ilvara Xanthe Zelda Nevin Sorrel Maristel Mirela Hadrin Branwen Tamsin Tobin Wendrel Lorcan Eskil Dorthea Corvin Petrova Vesna Florin Anselka
Rosamir Calder Daphira Oriel Kestra Jorund Quillan Gisla Yorick Ulric Anna Peter Maria John Elena Thomas Laura Daniel Nina Oscar Ivan Clara Hugo Marta""".split()
STEMS = "Pell Ren Yarr Dorn Hal Thorn Quar Wex Cald Mor Tov Var Ulv Zeb Brin Kess Fenn Ost Sand Lind".split()
ENDINGS = "gard quist owitz ova enko hurst hollow berry ström mere ington well wright ford anik elius aday sen son man ton ley".split()
FAMILY_ZH = list("王李张刘陈杨赵黄吴徐孙胡朱高林何郭马罗梁宋郑谢韩唐冯于董萧程曹袁邓许傅沈曾彭吕苏卢蒋蔡贾丁魏薛叶阎余潘杜戴夏钟汪田任姜范方石姚谭廖邹熊金陆郝孔白崔康毛邱秦江史顾侯邵孟龙万段雷钱汤尹黎易常武乔贺赖龚文虞翟颜祁岑阮宓蔺简柏沐")
FAMILY_ZH_TWO = "上官 端木 慕容 令狐 闻人 仲孙 东方 欧阳 司马 诸葛 皇甫 尉迟 公孙 长孙 司徒 夏侯".split()
RARE_ZH = list("虞翟颜祁岑阮宓蔺简柏沐")
GIVEN_ZH = list("蘅栩朔澄芜淮槿泠溪钧笙祎昀沅珩霁屿砚鸢筠岫琬昊轩宇涵萱琪瑶雯婷霖峻逸")
STREETS = "Umber Yarrow Old Saddler Quince Vesper Linden Ferry Mill Tanner Upper Mossy Cobalt Willow Pewter Larkfield Harrow Park Church Station Maple".split()
STREET_KINDS = "St. St Street Road Rd Lane Avenue Ave Way Close Terrace Drive Court Boulevard Blvd Rd. Ave.".split()
TOWNS = "Pellbridge Tarnholt Norrvik Brackwell Ashquay Kelvaston Ostermere Dunmarrow".split()
CITIES_ZH = "澜沧洲市 青榆县 云岭市松涛区 临川市望鹤区 白鹭市烟汀镇 北原市 南溪市东港区 河湾县".split()
ROADS_ZH = "烟汀 听雨 晚枫 白鹭 临川 松涛 云岭 青榆 石桥 望鹤 长宁 中山 人民 解放".split()
NOUNS = """ledger lantern signal orchard harbor meadow voucher kettle ticket bracket garden recipe schedule draft meeting umbrella tenant source index quarry
notebook balance margin compass workshop pantry elevator landlord receipt timeline weekend update concept method outline engine habit jacket queue evidence
errand guideline table page commute review deposit window notice invoice shelter vendor needle pattern journal junction whistle claim sample question summary canvas cabinet project bicycle overview incident hallway handover visa rehearsal fabric fence yard plan tenant harbor conference road depot warehouse railing bridge review exam keyboard glossary apprentice""".split()
ADJECTIVES = "partial uneven rapid complete optional weekly pending younger joint plain early late quick fresh slow large costly inner routine explicit narrowed layered scoped reusable mixed private copper eager patient warm sharp broken empty hidden thin some neutral green cautious mossy calm dusty formal narrow quiet steady sharp hollow muddy urgent useful honest brittle careful modest seasonal idle keen visible tentative fragile global manual outer nested".split()
VERBS = "polishes defers explains describes hides quotes pairs offsets tightens softens filters revises supports moves joins unlocks lists narrows orders tests tracks maps wraps confirms drops informs keeps covers checks sorts guards measures delays handles groups follows prepares labels borrows splits matches repairs settles questions frames traces stretches reads opens merges".split()
ADVERBS = "first nearly already before entirely briefly often soon carefully everywhere together apart upstream downstream barely polishes defers explains describes hides quotes pairs offsets tightens softens filters revises supports moves joins unlocks lists narrows orders tests tracks maps wraps confirms drops informs keeps covers slowly quietly later again soon elsewhere mostly eventually twice partly yesterday tonight openly rarely".split()
DETERMINERS = "the a any each every some my your their our its no this that another one".split()
PREPOSITIONS = "to with from near for into by on across against under behind within beyond during toward beside around after without along".split()
LINKS = "because while although unless if since once but so whereas despite".split()
PROJECTS = "Cobalt Pewter Ember Willow Harrow Juniper Marble Copper Basalt Fennel Granite Thistle Larkfield Saffron".split()
PROJECT_KINDS = "Harvest Bridge Compass Console Index Module Relay Review Signal Garden Ledger Plan Engine Launch Quarry Lantern Archive Beacon Notebook Harbor Summit Orchard Workshop Meadow".split()
NOUNS_ZH = """方法 概念 日志 决策 走廊 习惯 规则 问题 面试 路线 通勤 样张 复盘 车间 边界 雨伞 信号 包裹 答案 考试 结论 索引 图表 布料 手册 发票 清单 菜谱 线索 周报 窗户 方案 图表 房东 天气 学徒 编辑 合同 书架 梯子 水壶 课程 流程 目录 证据 行李 车票 提纲 任务 布料 桌子 记录 灯笼 室友 山谷 花园 花园 页边 阳台 老师 经理 邻居 护照夹 自行车
会议 同事 考试 排练 仓库 版本 接口 工具 预算 队列 租约 来源 结论 草稿 草地 果园 电梯 早餐 晚饭 收据 港口 厨房 项目 材料 模板 标签 支架 样本 档案 客户 账本 假设 节奏 目标 提醒 引擎""".split()
VERBS_ZH = """核对 权衡 拒绝 固定 抵消 阻止 引用 标注 导出 果断 分享 打包 配对 分配 改写 采集 暂停 反对 同意 寄送 抄写 检查 推迟 限制 导入 安排 阅读 整理 记下 评估 排序 测试 调整 修订 更新 取消 预订 等待 计划 收集 描述 覆盖 处理 列出 支持 移动 解释 提高 打开 放弃 匹配 测量 采纳 归还 重复 过滤 确认 解锁 跟进 完成 通知 讨论 保留 隐藏 借用
合并 拆分 缩小 延长 追踪 准备 质疑 收紧 守住 塑造 交接 回顾 修补 加入 携带 归类 包装""".split()
ADJ_ZH = "急切 内部 耐心 适度 季节性 手工 待定 过时 可见 外部 固定 诚恳 局部 单薄 空洞 温和 不均 早期 本地 完整 每周 安静 整洁 迟到 粗糙 正式 明确 空白 稳定 常规 直接 微弱 有用 积灰 温暖 沉默 泥泞 最近 狭窄 破损 密集 沉重 朴素 隐蔽 可选 联合 全局 谨慎 共享 嵌套 锋利 私人 模糊 新鲜 脆弱 闲置 混合 中立 昂贵 快速 诚实 简单 高级 平静".split()
TIME_ZH = "昨天 今天 明早 周末 下周 上个月 开春 入冬 凌晨 午后 之前 随后 临时 暂时 果然 其实 大概 偶尔 经常 平时 首先 分别 反复 逐步 按时 另外 提前 一起 月底 刚才".split()
JOINTS_ZH = "虽然 因为 所以 如果 直到 除非 只要 同时 于是 但是 并且 不过 而且".split()
HOSTS = "mail.example example.test field-notes.test inbox.example post.invalid node7.corp.invalid work.example.org mailbox.net".split()


class Maker:
    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def pick(self, pool):
        return self.r.choice(pool)

    def digits(self, n: int) -> str:
        return "".join(self.r.choice("0123456789") for _ in range(n))

    def syllables(self) -> str:
        return "".join(self.pick(["ba", "ri", "to", "len", "mar", "vi", "ska", "dor", "ne", "la", "ko", "per", "wen", "jo", "ul", "tha"]) for _ in range(self.r.randint(2, 3))).capitalize()

    def family(self) -> str:
        return self.pick(STEMS) + self.pick(ENDINGS) if self.r.random() < 0.85 else self.syllables()

    def name(self) -> str:
        r = self.r.random()
        if r < 0.5:
            given = self.pick(GIVEN) if self.r.random() < 0.85 else self.syllables()
            family, k = self.family(), self.r.random()
            if k < 0.16:
                return f"{family}, {given}"
            if k < 0.3:
                return f"{given} {self.pick('ABCDEFGHJKLMNPRST')}. {family}"
            if k < 0.4:
                return f"{given} {family}".upper()
            if k < 0.58:  # a lower-case name shows itself by its words alone
                return f"{self.pick(GIVEN)} {self.pick(STEMS)}{self.pick(ENDINGS)}".lower()
            return f"{given} {family}"
        family = self.pick(FAMILY_ZH_TWO) if self.r.random() < 0.35 else self.pick(RARE_ZH if self.r.random() < 0.7 else FAMILY_ZH)
        given = "".join(self.pick(GIVEN_ZH) for _ in range(self.r.choice((1, 1, 2))))
        return family + (" " if self.r.random() < 0.25 else "") + given

    def email(self) -> str:
        r = self.r.random()
        if r < 0.3:
            local = self.pick(GIVEN).lower() + self.digits(self.r.randint(1, 2))
        elif r < 0.5:
            local = f"{self.pick(NOUNS)}-{self.digits(3)}"
        elif r < 0.7:
            local = f"{self.pick(NOUNS)}.{self.pick(NOUNS)}"
        else:
            local = f"{self.pick(ADJECTIVES)}_{self.pick(NOUNS)}+{self.pick(NOUNS)}"
        host, r = self.pick(HOSTS), self.r.random()
        if r < 0.5:
            out = f"{local}@{host}"
        elif r < 0.6:
            out = f"{local} @ {host}"
        elif r < 0.72:
            out = f"{local} (at) {host}"
        elif r < 0.86:
            out = f"{local} at {host.replace('.', ' dot ')}"
        elif r < 0.9:
            out = f"{local}[at]{host}"
        else:
            out = f"{local}＠{host}"
        return out.upper() if self.r.random() < 0.08 else out

    def phone(self) -> str:
        cn = self.pick(["138", "159", "186", "177", "131", "150", "199"])
        r = self.r.randint(0, 12)
        us = self.r.randint(200, 999)
        tail = self.digits(4)
        return [
            f"{cn}{self.digits(8)}", f"{cn} {self.digits(4)} {tail}", f"{cn}-{self.digits(4)}-{tail}", f"+86 {cn}{self.digits(8)}", f"(0086){cn}{self.digits(8)}",
            "".join(chr(ord(c) + 0xFEE0) for c in f"{cn}{self.digits(8)}"), f"+44 7700 {self.digits(6)}", f"07700 {self.digits(6)}", f"+1 ({us}) 555-{tail}",
            f"{us}-555-{tail}", f"{us}.555.{tail}", f"+1{us}555{tail}", f"({us}) 555-{tail}" if self.r.random() < 0.5 else f"({us})555-{tail}",
        ][r]

    def id_number(self) -> str:
        date = f"{self.r.randint(1950, 2008)}{self.r.randint(1, 12):02d}{self.r.randint(1, 28):02d}"
        area, tail = self.pick(["90", "11", "44"]) + self.digits(4), self.digits(3) + self.pick("0123456789Xx" if self.r.random() < 0.4 else "0123456789")
        r = self.r.random()
        if r < 0.3:
            return area + date + tail
        if r < 0.45:
            return f"{area} {date} {tail}"
        if r < 0.53:
            return "".join(chr(ord(c) + 0xFEE0) for c in area + date + tail)
        if r < 0.78:
            return f"9{self.digits(2)}-{self.digits(2)}-{self.digits(4)}"
        return self.pick(["XK", "ZW", "YQ", "XW", "ZK", "YK", "XQ", "E", "G"]) + self.digits(self.r.choice((7, 7, 8)))

    def address(self) -> str:
        if self.r.random() < 0.5:
            n = str(self.r.randint(1, 420))
            wide = lambda x: "".join(chr(ord(c) + 0xFEE0) for c in x)
            head = (self.pick(CITIES_ZH) if self.r.random() < 0.75 else "") + self.pick(ROADS_ZH) + self.pick(["路", "街", "巷", "大道"])
            return head + self.pick([f"{n}号", f" {n} 号 {self.r.randint(1, 20)} 栋", f"{n}弄{self.r.randint(1, 30)}号{self.r.randint(101, 1900)}室", f"{wide(n)}号", f"{n}号"])
        n = str(self.r.randint(1, 420)) + (self.pick("ABC") if self.r.random() < 0.25 else "")
        street = f"{n} {self.pick(STREETS)} {self.pick(STREET_KINDS)}"
        case = self.r.random()
        street = street.lower() if case < 0.3 else street.upper() if case < 0.34 else street
        r = self.r.random()
        if r < 0.2:
            return f"Flat {self.r.randint(1, 30)}{self.pick('ABC')}, {street}, {self.pick(TOWNS)} {self.digits(5)}"
        if r < 0.4:
            return f"{street}, Apt {self.r.randint(1, 60)}"
        return f"{street}, {self.pick(TOWNS)}" if r < 0.7 else street

    def noun_en(self) -> str:
        return f"{self.pick(DETERMINERS)} {self.pick(ADJECTIVES)} {self.pick(NOUNS)}"

    def clause_en(self) -> str:
        s = f"{self.noun_en()} {self.pick(VERBS)} {self.noun_en()} {self.pick(ADVERBS)}"
        s += f" {self.pick(LINKS)} {self.noun_en()}" if self.r.random() < 0.4 else ""
        return (s[0].upper() + s[1:] if self.r.random() < 0.7 else s) + self.pick([".", "!", "?", ";", ""])

    def clause_zh(self) -> str:
        a = f"{self.pick(TIME_ZH)}{self.pick(VERBS_ZH)}{self.pick(ADJ_ZH)}的{self.pick(NOUNS_ZH)}"
        b = f"{self.pick(NOUNS_ZH)}{self.pick(TIME_ZH)}{self.pick(VERBS_ZH)}了{self.pick(NOUNS_ZH)}"
        c = f"{self.pick(ADJ_ZH)}的{self.pick(NOUNS_ZH)}需要{self.pick(TIME_ZH)}{self.pick(VERBS_ZH)}{self.pick(NOUNS_ZH)}"
        first = self.pick([a, b, c])
        if self.r.random() < 0.35:
            first += f"，{self.pick(JOINTS_ZH)}{self.pick([a, b, c])}"
        return first + self.pick(["。", "；", "！", "？", ""])

    def noise(self) -> str:
        r = min(self.r.randint(0, 30), 28)
        p = f"{self.pick(PROJECTS)} {self.pick(PROJECT_KINDS)}"
        hexa = "".join(self.r.choice("0123456789abcdef") for _ in range(self.r.choice((16, 31, 32, 32))))
        date = f"{self.r.randint(2020, 2027)}-{self.r.randint(1, 12):02d}-{self.r.randint(1, 28):02d}"
        return [
            f"{p} is on hold", f"{p} 暂停了", f"order no. {self.digits(13)}", f"订单号{self.digits(13)}", f"parcel {self.digits(18)}", f"快递单{self.digits(18)}",
            f"build {self.digits(2)}.{self.digits(2)}.{self.digits(3)}", f"{date} {self.digits(2)}:{self.digits(2)}", date, f"¥{self.digits(2)},{self.digits(3)}.{self.digits(2)}",
            f"{self.r.randint(1, 40)} km of road in {self.pick(TOWNS)}", f"路上走了{self.r.randint(1, 40)}公里", f"{self.r.randint(1, 30)}号下午，{self.r.randint(100, 999)}会议室", f"seat {self.pick('ABCDEF')}{self.r.randint(1, 40)}, room {self.r.randint(1, 900)}",
            f"ticket {self.pick('XZQY')}{self.pick('KVWQ')}-{self.digits(4)}", f"ask {self.pick(['Mr.', 'Ms.', 'Dr.', 'Mrs.'])} {self.family()}", f"{self.pick(RARE_ZH + FAMILY_ZH)}{self.pick(['老师', '师傅', '经理', '医生', '总'])}在吗", f"@{self.pick(NOUNS)}_{self.pick(NOUNS)} see above",
            f"wxid_{self.pick(NOUNS)}{self.digits(3)}@ missing host", f"https://{self.pick(NOUNS)}.example/{self.pick(NOUNS)}/{self.digits(5)}", hexa, f'<msg><img md5="{hexa[:16]}" filename="img-{self.digits(2)}.jpg" /></msg>',
            f'<msg><voicemsg filename="voice-{self.digits(3)}.silk" /></msg>', f"<msg><appmsg><type>6</type><title>{self.pick(NOUNS)}-{self.pick(NOUNS)}.pdf</title><des>{self.clause_zh()}</des></appmsg></msg>", "好的，嗯嗯", "ok thanks",
            f"<msg><appmsg><type>57</type><title>{self.clause_en()}</title><refermsg><displayname>{self.pick(ADJECTIVES)}-{self.pick(NOUNS)}</displayname><content>{self.clause_zh()}</content></refermsg></appmsg></msg>", self.pick([f"房东叫{self.family()}", f"{self.family()} called", f"{self.pick(GIVEN)} said hi"]),
            "".join(self.r.choice("0123456789abcdef") for _ in range(32)),
        ][r]

    def phrase(self) -> list[tuple[str, str | None]]:
        """A phrase with one piece of personal information."""
        kind = self.pick(KINDS)
        value = {"email": self.email, "phone": self.phone, "id_number": self.id_number, "street_address": self.address, "name": self.name}[kind]()
        r = self.r.random()
        if r > 0.8 and kind != "name":
            return [(value, kind)]
        if r < 0.2 and kind != "name":
            a, b = (f"{self.pick(NOUNS_ZH)}{self.pick(TIME_ZH) if self.r.random() < 0.3 else ''}{self.pick(VERBS_ZH)}到", f"，{self.clause_zh()}")
        elif r < 0.4 and kind != "name":
            a, b = (f"{self.noun_en()} {self.pick(VERBS)} {self.pick(PREPOSITIONS)} ", f" {self.pick(LINKS)} {self.clause_en()}")
        elif r < 0.2 and kind == "name":
            a, b = (self.pick(TIME_ZH), f"{self.pick(VERBS_ZH)}了{self.pick(ADJ_ZH)}的{self.pick(NOUNS_ZH)}")
        elif r < 0.4 and kind == "name":
            a, b = (f"{self.pick(ADVERBS)} ", f" {self.pick(VERBS)} {self.noun_en()}")
        else:
            a, b = self.pick({
                "email": [("mail=", ";"), ("write to ", " before friday"), ("my new inbox is ", ""), ("<", ">"), ("&lt;", "&gt;"), ("发到 ", " 就行"), ("邮箱 ", " ，别发错"), ("联系：", ""), ("抄送 ", " 吧"), ("", " works best"), ("", "")],
                "phone": [("call ", " after six"), ("text me (", ")"), ("tel:", ""), ("my number changed to ", ""), ("reach the desk on ", " please"), ("手机", ""), ("打 ", " 找我"), ("微信同号 ", ""), ("号码换成 ", " 了"), ("", "")],
                "id_number": [("use my identity number ", " for the permit"), ("the form wants ", ""), ("", " is what the clerk typed"), ("id ", ""), ("身份证", ""), ("登记用 ", " 就可以"), ("证件号：", ""), ("", "")] if not value[:2].isalpha() and not value[0] in "EG"
                else [("passport ", ""), ("passport no. ", " expires soon"), ("the passport number is ", ""), ("护照号 ", ""), ("护照", "快到期了"), ("the form wants ", "")],
                "street_address": [("send it to ", ""), ("home: ", ";"), ("we moved to ", ""), ("pick up at ", " on monday"), ("寄到", ""), ("地址：", ""), ("我搬到", "了"), ("在", "门口等"), ("", "")],
                "name": [("signed, ", ""), ("ask ", " about the lease"), ("thanks to ", " for the notes"), ("we met ", " near the depot"), ("the landlord, ", ", said no"), ("", " agreed to review it"), ("", ": fine by me"), ("", "：收到"), ("", "说可以"), ("房东叫", ""),
                         ("问一下 ", " 吧"), ("昨天碰到 ", " 了"), ("跟", "约好了"), ("", ""),
                         ("<msg><appmsg><type>57</type><title>" + self.clause_zh() + "</title><refermsg><displayname>", "</displayname><content>" + self.clause_en() + "</content></refermsg></appmsg></msg>")],
            }[kind])
        return [(a, None), (value, kind), (b, None)]

    def row(self) -> tuple[str, list[tuple[int, int, str]]]:
        out: list[tuple[str, str | None]] = []
        if self.r.random() < 0.2:
            out.append((f"wxid_{self.pick(NOUNS)}{self.digits(8)}:\n", None))
        joint = self.pick(["\n", "；", "，", " | ", "; ", ", ", "\n", ";\n"])
        for i in range(self.r.randint(1, 4)):
            if i:
                out.append((joint, None))
            r = self.r.random()
            out += self.phrase() if r < 0.5 else [(self.noise() if r < 0.75 else self.clause_zh() if r < 0.88 else self.clause_en(), None)]
        r = self.r.random()
        plain = lambda: self.pick([self.clause_zh, self.clause_en, self.noise])()
        shown = lambda: [(self.name(), "name")] if self.r.random() < 0.5 else [(f"{self.pick(ADJECTIVES)}-{self.pick(NOUNS)}", None)]
        if r < 0.1:
            out = [("<msg><appmsg><type>57</type><title>", None), *out, ("</title><refermsg><displayname>", None), *shown(), (f"</displayname><content>{plain()}</content></refermsg></appmsg></msg>", None)]
        elif r < 0.2:
            out = [(f"<msg><appmsg><type>57</type><title>{plain()}</title><refermsg><displayname>", None), *shown(), ("</displayname><content>", None), *out, ("</content></refermsg></appmsg></msg>", None)]
        elif r < 0.24:
            out = [("<msg><appmsg><type>19</type><title>", None), *out, (f"</title><des>{self.r.randint(2, 60)} items</des></appmsg></msg>", None)]
        elif r < 0.28:
            out = [(f"<msg><appmsg><type>6</type><title>{self.pick(NOUNS)}-{self.pick(NOUNS)}.pdf</title><des>", None), *out, ("</des></appmsg></msg>", None)]
        text, spans = "", []
        for piece, kind in out:
            if kind:
                spans.append((len(text), len(text) + len(piece), kind))
            text += piece
        return text, spans


def labelled_table(rows: int = ROWS, seed: int = 20) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """(text, spans) of the labelled table. Its size is a parameter and does not grow with the data."""
    m = Maker(seed)
    return [m.row() for _ in range(rows)]
