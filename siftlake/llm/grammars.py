"""Lexers and grammars of the languages, as far as the syntax of tokens goes.

The grammars are those of the languages' public specifications, brought to the form that
chart.py reads: operators without precedence, statements as pieces of a list.
"""

from __future__ import annotations

import re

from siftlake.llm.chart import Grammar

_CONFLICT = r"(?P<conflict>^(?:<<<<<<<|>>>>>>>|\|\|\|\|\|\|\||=======)(?=[ \r\n]|\Z)[^\n]*)"
_NUM = r"(?P<num>(?:0[xX][0-9a-fA-F_]+n?|0[bB][01_]+n?|0[oO][0-7_]+n?|(?:[0-9][0-9_]*(?:\.[0-9][0-9_]*|\.(?![._A-Za-z]))?|\.[0-9][0-9_]*)(?:[eE][+-]?[0-9_]+)?)(?P<suffix>[A-Za-z_][A-Za-z0-9_]*)?)"
_WORD = r"(?P<word>[^\W\d]\w*)"


def _lexer(strings: str, comments: str, operators: list[str], word: str = _WORD) -> re.Pattern:
    ops = "|".join(re.escape(o) for o in sorted(operators, key=len, reverse=True))
    return re.compile(f"{_CONFLICT}|(?P<nl>\\r?\\n)|(?P<space>[ \\t\\f\\r\\u00a0\\ufeff]+)|(?P<comment>{comments})|(?P<string>{strings})|{_NUM}|{word}|(?P<op>{ops})|(?P<bad>.)", re.M | re.S)


_DQ, _SQ = r'"(?:[^"\\\n]|\\(?:\r\n|[\s\S]))*"', r"'(?:[^'\\\n]|\\(?:\r\n|[\s\S]))*'"
_C_COMMENTS = r"//[^\n]*|/\*[\s\S]*?\*/"
_BRACKETS = ["(", ")", "[", "]", "{", "}"]
_C_OPS = ["+", "-", "*", "/", "%", "&", "|", "^", "~", "!", "<", ">", "=", "?", ":", ";", ",", ".", "@", "==", "!=", "<=", ">=", "&&", "||", "++", "--", "+=", "-=", "*=", "/=", "%=", "&=", "|=", "^=", "<<", "<<=", "->", "...", "::", *_BRACKETS]

PYTHON_WORDS = set("False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield".split())
JS_WORDS = set("break case catch class const continue debugger default delete do else export extends finally for function if import in instanceof new return super switch this throw try typeof var void while with yield await null true false enum let".split())
GO_WORDS = set("break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var".split())
JAVA_WORDS = set("abstract assert boolean break byte case catch char class const continue default do double else enum extends final finally float for goto if implements import instanceof int interface long native new package private protected public return short static strictfp super switch synchronized this throw throws transient try void volatile while true false null".split())
RUST_WORDS = set("as break const continue crate else enum extern false fn for if impl in let loop match mod move mut pub ref return self Self static struct super trait true type unsafe use where while async await dyn".split())

_SUFFIXES = {
    "python": r"[jJ]", "javascript": r"n", "typescript": r"n", "go": r"i", "java": r"[lLfFdD]", "json": r"(?!)",
    "rust": r"_*(?:[iu](?:8|16|32|64|128|size)|f32|f64)",
}

LEXERS = {
    "python": _lexer(r"[rRbBfFuUtT]{0,2}(?:" + r'"""(?:[^\\]|\\[\s\S])*?"""' + r"|'''(?:[^\\]|\\[\s\S])*?'''|" + _DQ + "|" + _SQ + ")", r"#[^\n]*|\\\r?\n", ["+", "-", "*", "/", "%", "@", "&", "|", "^", "~", "<", ">", "=", ":", ";", ",", ".", "==", "!=", "<=", ">=", "**", "//", "<<", ">>", "->", ":=", "...", "+=", "-=", "*=", "/=", "//=", "%=", "@=", "&=", "|=", "^=", ">>=", "<<=", "**=", "!", *_BRACKETS]),
    "javascript": _lexer(_DQ + "|" + _SQ + r"|`(?:[^`\\$]|\\[\s\S]|\$\{(?:[^{}`]|\{[^{}]*\}|`[^`]*`)*\}|\$)*`", r"//[^\n]*|/\*[\s\S]*?\*/|\A#![^\n]*", [*[o for o in _C_OPS if o not in ("::", "->")], "===", "!==", "**", "**=", "??", "??=", "&&=", "||=", "?.", "=>", ">>", ">>>", ">>=", ">>>=", "#"], r"(?P<word>[^\W\d]\w*|[$][\w$]*)(?P<dollar>[$][\w$]*)?"),
    "go": _lexer(_DQ + r"|`[^`]*`|'(?:[^'\\\n]|\\[^\n]{1,9})'", _C_COMMENTS, [*[o for o in _C_OPS if o not in ("::", "->", "?", "@")], ":=", "<-", "&^", "&^=", ">>", ">>=", "~"]),
    "java": _lexer(r'"""[\s\S]*?"""|' + _DQ + r"|'(?:[^'\\\n]|\\[^\n]{1,6})'", _C_COMMENTS, _C_OPS, r"(?P<word>[^\W\d]\w*|[$][\w$]*)(?P<dollar>[$][\w$]*)?"),
    "rust": _lexer(r'[bc]?r(?P<hash>#*)"[\s\S]*?"(?P=hash)|[bc]?"(?:[^"\\]|\\[\s\S])*"|b?' + r"'(?:[^'\\\n]|\\(?:x[0-9a-fA-F]{2}|u\{[0-9a-fA-F_]+\}|[^\n]))'", r"//[^\n]*|/\*(?:[^*/]|\*(?!/)|/(?!\*)|/\*[\s\S]*?\*/)*\*/", [*_C_OPS, "=>", "..", "..=", "#", "$"], r"(?P<word>(?:r#)?[^\W\d]\w*)|(?P<life>'[^\W\d]\w*)"),
    "json": _lexer(r'"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*"', r"(?!)", ["-", ":", ",", *_BRACKETS]),
}
# In types >> closes two lists, so that TypeScript's shifts are read as single signs.
LEXERS["typescript"] = re.compile(LEXERS["javascript"].pattern.replace("|>>>=", "").replace("|>>>", "").replace("|>>=", "").replace("|>>", "").replace("(?P<op>>>>=|", "(?P<op>"), re.M | re.S)
# A number may end in its point before another one in JavaScript; hexadecimal fractions; a point before digits is a field in Rust.
_HEX = r"0[xX][0-9a-fA-F_]*(?:\.[0-9a-fA-F_]*)?[pP][+-]?[0-9]+|0[xX]"
for _name, _old, _new in [("javascript", r"\.(?![._A-Za-z])", r"\.(?![_A-Za-z])"), ("typescript", r"\.(?![._A-Za-z])", r"\.(?![_A-Za-z])"), ("go", "0[xX]", _HEX), ("java", "0[xX]", _HEX), ("rust", r"|\.[0-9][0-9_]*)", ")")]:
    assert _old in LEXERS[_name].pattern
    LEXERS[_name] = re.compile(LEXERS[_name].pattern.replace(_old, _new, 1), re.M | re.S)
WORDS = {"python": PYTHON_WORDS, "javascript": JS_WORDS, "typescript": JS_WORDS, "go": GO_WORDS, "java": JAVA_WORDS, "rust": RUST_WORDS, "json": {"true", "false", "null"}}

_EXPR_JS = """
expr = assign (',' assign)*
assign = 'yield' '*'? assign? | cond
cond = bin ('?' assign ':' assign)?
bin = operand (binop operand)*
binop = '+' | '-' | '*' | '/' | '%' | '**' | '&' | '|' | '^' | '<<' | '>>' | '>>>' | '==' | '!=' | '===' | '!==' | '<' | '>' | '<=' | '>=' | '&&' | '||' | '??' | 'in' | 'instanceof'
 | '=' | '+=' | '-=' | '*=' | '/=' | '%=' | '**=' | '&=' | '|=' | '^=' | '<<=' | '>>=' | '>>>=' | '&&=' | '||=' | '??='
operand = arrow | prefix* postfix
prefix = '!' | '-' | '+' | '~' | 'typeof' | 'void' | 'delete' | 'await' | '++' | '--' | 'new'
postfix = primary tail*
tail = '.' name | '?.' (name | P:args | S:expr) | P:args | S:expr | TPL | '++' | '--'
name = ID | '#' ID | KEYWORD
id = ID | 'let' | 'await' | 'yield'
function = 'function' '*'? id? P:params C:stmts
body = C:stmts
asyncf = 'async' function
arrow = 'async'? (id | P:params) '=>' (C:stmts | assign)
args = (arg (',' arg)* ','?)?
arg = '...'? assign
array = ','* (arg (','+ arg)* ','*)?
object = (prop (',' prop)* ','?)?
prop = '...' assign | key ':' assign | id ('=' assign)? | method
method = ('async' | 'get' | 'set' | 'static' | '*')* key P:params C:stmts
key = name | STR | TPL | NUM | S:assign
params = (param (',' param)* ','?)?
param = '...'? pattern ('=' assign)?
pattern = id | S:array | C:object
classx = 'class' id? ('extends' postfix)? C:members
member = ';' | method | 'static' C:stmts | 'static'? key ('=' assign)? end
end = ';' | ASI | EOS
vars = ('var' | 'let' | 'const') binding (',' binding)*
binding = pattern ('=' assign)?
forhead = (vars | expr)? ';' expr? ';' expr? | (('var' | 'let' | 'const') pattern | postfix) ('of' | 'in') expr
cases = (('case' expr | 'default') ':' (ASI | stmt)*)*
catches = P:pattern
"""

JS = _EXPR_JS + """
primary = ID | 'let' | 'async' | NUM | STR | TPL | REGEX | 'this' | 'null' | 'true' | 'false' | 'super' | P:expr | S:array | C:object | function | asyncf | classx | 'import' P:args | 'import' '.' ID | 'new' '.' ID
stmt = ';' | ASI | C:stmts | vars end | function | asyncf | classx | 'if' P:expr stmt ('else' stmt)? | 'for' 'await'? P:forhead stmt | 'while' P:expr stmt | 'do' stmt 'while' P:expr end? | 'return' expr? end | ('break' | 'continue') id? end | 'throw' expr end
 | 'try' C:stmts ('catch' P:pattern? C:stmts)? ('finally' C:stmts)? | 'switch' P:expr C:cases | 'with' P:expr stmt | id ':' stmt | 'debugger' end | import | export | expr end
import = 'import' (STR | (ID (',' ('*' 'as' ID | C:names))? | '*' 'as' ID | C:names) 'from' STR) ('with' C:object)? end
export = 'export' ('default' (function | asyncf | classx | assign end) | vars end | function | asyncf | classx | C:names ('from' STR)? end | '*' ('as' name)? 'from' STR end)
names = (spec (',' spec)* ','?)?
spec = (name | STR) ('as' (name | STR))?
"""

TS = _EXPR_JS.replace("'>>' | '>>>'", "'>' '>' | '>' '>' '>'").replace("'>>=' | '>>>='", "'>' '>=' | '>' '>' '>='").replace("function = 'function' '*'? id? P:params C:stmts", "function = 'function' '*'? id? typeparams? P:params returns? (C:stmts | end)").replace(
    "arrow = 'async'? (id | P:params) '=>'", "arrow = 'async'? (id | typeparams? P:params returns?) '=>'"
).replace("method = ('async' | 'get' | 'set' | 'static' | '*')* key P:params C:stmts", "method = modifier* key ('?' | '!')? typeparams? P:params returns? (C:stmts | end)").replace(
    "param = '...'? pattern ('=' assign)?", "param = decorator* modifier* '...'? (pattern | 'this') '?'? (':' type)? ('=' assign)?"
).replace("classx = 'class' id? ('extends' postfix)? C:members", "classx = 'class' id? typeparams? ('extends' postfix typeargs? P:args?)? ('implements' type (',' type)*)? C:members").replace(
    "member = ';' | method | 'static' C:stmts | 'static'? key ('=' assign)? end", "member = ';' | ASI | decorator+ ASI? | method | 'static' C:stmts | modifier* key ('?' | '!')? (':' type)? ('=' assign)? end | modifier* S:index ':' type end"
).replace("binding = pattern ('=' assign)?", "binding = pattern '!'? (':' type)? ('=' assign)?").replace("tail = '.' name", "tail = '!' | ('as' | 'satisfies') (type | 'const') | typeargs | '.' name").replace(
    "catches = P:pattern", "catches = pattern (':' type)?"
) + """
primary = ID | 'let' | 'async' | NUM | STR | TPL | REGEX | 'this' | 'null' | 'true' | 'false' | 'super' | P:expr | S:array | C:object | function | asyncf | classx | 'import' P:args | 'import' '.' ID | 'new' '.' ID | typeargs operand
modifier = 'async' | 'get' | 'set' | 'static' | '*' | 'public' | 'private' | 'protected' | 'readonly' | 'abstract' | 'override' | 'declare' | 'accessor'
decorator = '@' postfix
returns = ':' ('asserts'? (ID | 'this') 'is' type | 'asserts' ID | type)
typeparams = '<' typeparam (',' typeparam)* ','? '>'
typeparam = ('const' | 'in' | 'out')* ID ('extends' type)? ('=' type)?
typeargs = '<' type (',' type)* '>'
type = '|'? '&'? tunion ('extends' tunion '?' type ':' type)?
tunion = tpost (('|' | '&') tpost)*
tpost = ('keyof' | 'typeof' | 'readonly' | 'unique' | 'infer' | 'asserts')* tprimary (S:tindex | '!' )*
tprimary = ('new' | 'abstract' 'new')? typeparams? P:params '=>' (ID 'is' type | type) | tname | 'void' | 'null' | 'this' | 'true' | 'false' | '-'? NUM | STR | TPL | P:type | S:ttuple | C:tmembers | C:mapped | 'import' P:args ('.' ID)*
tname = (ID | 'typeof') ('.' name)* typeargs? | 'import' P:args
tindex = type?
ttuple = (telement (',' telement)* ','?)?
telement = '...'? (ID '?'? ':')? type '?'?
mapped = ('+' | '-')? 'readonly'? S:mapkey (('+' | '-')? '?')? ':' type end?
mapkey = ID 'in' type ('as' type)?
index = ID ':' type
tmembers = (tmember | ';' | ',' | ASI)*
tmember = 'new'? typeparams? P:params returns? | modifier* S:index ':' type | modifier* key '?'? (':' type | typeparams? P:params returns?)?
stmt = ';' | ASI | C:stmts | vars end | function | asyncf | decorator* ASI? 'abstract'? classx | 'if' P:expr stmt ('else' stmt)? | 'for' 'await'? P:forhead stmt | 'while' P:expr stmt | 'do' stmt 'while' P:expr end? | 'return' expr? end | ('break' | 'continue') id? end | 'throw' expr end
 | 'try' C:stmts ('catch' P:catches? C:stmts)? ('finally' C:stmts)? | 'switch' P:expr C:cases | id ':' stmt | 'debugger' end | import | export | declaration | expr end
declaration = 'declare'? ('interface' ID typeparams? ('extends' type (',' type)*)? C:tmembers | 'type' ID typeparams? '=' type end | 'const'? 'enum' ID C:enums | ('namespace' | 'module') (ID ('.' ID)* | STR) C:stmts | 'global' C:stmts) | 'declare' (vars end | function | 'abstract'? classx)
enums = (key ('=' assign)? (',' key ('=' assign)?)* ','?)?
import = 'import' 'type'? (STR | (ID (',' ('*' 'as' ID | C:names))? | '*' 'as' ID | C:names) 'from' STR | ID '=' postfix) ('with' C:object)? end
export = 'export' ('default' (function | asyncf | 'abstract'? classx | declaration | assign end) | vars end | function | asyncf | 'abstract'? classx | declaration | 'type'? C:names ('from' STR)? end | '*' ('as' name)? 'from' STR end | '=' assign end | 'as' 'namespace' ID end) | 'export' decorator* classx
names = (spec (',' spec)* ','?)?
spec = 'type'? (name | STR) ('as' (name | STR))?
"""

# What JavaScript's grammar says beyond operators without precedence: targets of assignments, no unary operand before **, no
# ?? beside || or &&, initial values of constants and patterns, names of declared functions and classes.
for _old, _new in [
    ("assign = 'yield' '*'? assign? | cond\n", "assign = 'yield' '*'? assign? | target assignop assign | cond\n"),
    ("bin = operand (binop operand)*\n", "bin = operand ((binop | logic) operand)* | operand ((binop | '??') operand)*\n"),
    (" | '&&' | '||' | '??' | 'in' | 'instanceof'\n | '=' |", " | 'in' | 'instanceof'\nlogic = '&&' | '||'\nassignop = '=' |"),
    (" | '/' | '%' | '**' | '&'", " | '/' | '%' | '&'"),
    ("operand = arrow | prefix* postfix\n", "operand = arrow | unary+ update | update ('**' operand)?\nupdate = ('++' | '--') target | target ('++' | '--') | 'new'* postfix\ntarget = id | 'async' | S:array | C:object | 'new'* primary tail0* ('.' name | S:expr) | P:target\n"),
    ("prefix = '!' | '-' | '+' | '~' | 'typeof' | 'void' | 'delete' | 'await' | '++' | '--' | 'new'\n", "unary = '!' | '-' | '+' | '~' | 'typeof' | 'void' | 'delete' | 'await' | ('++' | '--' | 'new')+ unary\ntail0 = '.' name | P:args | S:expr | TPL\n"),
    ("vars = ('var' | 'let' | 'const') binding (',' binding)*\nbinding = pattern ('=' assign)?\n", "vars = ('var' | 'let') binding (',' binding)* | 'const' pattern '=' assign (',' pattern '=' assign)*\nbinding = id ('=' assign)? | (S:array | C:object) '=' assign\n"),
    ("vars end | function | asyncf | classx | 'if'", "vars end | named | 'async' named | 'class' id ('extends' postfix)? C:members | 'if'"),
    (" | S:expr | TPL | '++' | '--'\n", " | S:expr | TPL\n"),
    ("pattern | postfix) ('of' | 'in') expr", "pattern | target) ('of' | 'in') expr"),
    ("('catch' P:pattern? C:stmts)? ('finally' C:stmts)? | 'switch'", "('catch' P:pattern? C:stmts ('finally' C:stmts)? | 'finally' C:stmts) | 'switch'"),
    ("'import' '.' ID | 'new' '.' ID", "'import' '.' 'meta' | 'new' '.' 'target'"),
    ("id = ID | 'let' | 'await' | 'yield'", "id = ID | 'await' | 'yield'"), ("primary = ID | 'let' | 'async'", "primary = ID | 'async'"),
    ("forhead = (vars | expr)?", "named = 'function' '*'? id P:params C:stmts\nforhead = (vars | expr)?"),
]:
    assert _old in JS, _old
    JS = JS.replace(_old, _new)

JSON = """
text = value
value = STR | '-'? NUM | 'true' | 'false' | 'null' | C:object | S:array
object = (STR ':' value (',' STR ':' value)*)?
array = (value (',' value)*)?
"""

GO = """
top = ';' | 'package' ID ';' | 'import' (spec | P:specs) ';' | func ';' | decl ';'
spec = (ID | '.')? STR
specs = (spec ';')* spec?
func = 'func' P:params? ID typeparams? P:params results? C:stmts?
results = P:params | type
typeparams = S:tparams
tparams = tparam (',' tparam)* ','?
tparam = ID (',' ID)* constraint
constraint = '~'? type ('|' '~'? type)*
params = (param (',' param)* ','?)?
param = ID? '...'? type
decl = 'var' (vspec | P:vspecs) | 'const' (cspec | P:cspecs) | 'type' (tspec | P:tspecs)
vspec = ID (',' ID)* (type? '=' exprs | type)
vspecs = (vspec ';')* vspec?
cspec = ID (',' ID)* (type? '=' exprs)?
cspecs = (cspec ';')* cspec?
tspec = ID typeparams? '='? type
tspecs = (tspec ';')* tspec?
type = ID ('.' ID)? S:types? | '*' type | S:length type | 'map' S:type type | 'chan' '<-'? type | '<-' 'chan' type | 'func' P:params results? | 'struct' C:fields | 'interface' C:methods | P:type
types = type (',' type)*
length = (expr | '...')?
fields = (field ';')* field?
field = ID (',' ID)* type STR? | '*'? ID ('.' ID)? S:types? STR?
methods = (method ';')* method?
method = ID P:params results? | constraint
exprs = expr (',' expr)*
expr = unary (binop unary)*
binop = '+' | '-' | '*' | '/' | '%' | '&' | '|' | '^' | '<<' | '>>' | '&^' | '==' | '!=' | '<' | '>' | '<=' | '>=' | '&&' | '||'
unary = ('!' | '-' | '+' | '^' | '*' | '&' | '<-')* postfix
postfix = primary tail*
primary = ID | NUM | STR | P:expr | P:type | 'func' P:params results? C:stmts | literaltype C:elements | S:length type | 'map' S:type type | 'chan' type | 'struct' C:fields | 'interface' C:methods
literaltype = S:length type | 'map' S:type type | 'struct' C:fields
tail = '.' (ID | P:assert) | P:args | S:slice | C:elements
assert = type | 'type'
args = ((expr | type) (',' (expr | type))* '...'? ','?)?
slice = expr? ':' expr? (':' expr)? | (expr | type) (',' type)*
elements = (element (',' element)* ','?)?
element = (item ':')? item
item = expr | C:elements
simple = place (',' place)* '=' exprs | ID (',' ID)* ':=' exprs | place (('+=' | '-=' | '*=' | '/=' | '%=' | '&=' | '|=' | '^=' | '<<=' | '>>=' | '&^=') expr | '++' | '--') | expr ('<-' expr)?
place = ID | primary tail* ('.' ID | S:slice) | '*' unary | P:place
stmt = ';' | decl ';' | simple ';' | 'return' exprs? ';' | ('break' | 'continue' | 'goto') ID? ';' | 'fallthrough' ';' | ('go' | 'defer') expr ';' | C:stmts ';' | if ';' | 'for' forhead? C:stmts ';' | switch ';' | 'select' C:cases ';' | ID ':' ';'? stmt
if = 'if' (simple? ';')? simple C:stmts ('else' (if | C:stmts))?
forhead = simple? ';' simple? ';' simple? | (exprs ('=' | ':='))? 'range' expr | simple
switch = 'switch' (simple? ';')? (simple | (ID ':=')? postfix)? C:cases
cases = (('case' (simple | exprs | types) | 'default') ':' stmt*)*
"""

JAVA = """
top = ';' | annotation* 'package' qname ';' | 'import' 'static'? qname ('.' '*')? ';' | annotation* 'open'? 'module' qname C:directives | typedecl
directives = ('requires' ('transitive' | 'static')* qname ';' | ('exports' | 'opens') qname ('to' qname (',' qname)*)? ';' | 'uses' qname ';' | 'provides' qname 'with' qname (',' qname)* ';')*
qname = ID ('.' ID)*
mods = (annotation | 'public' | 'private' | 'protected' | 'static' | 'final' | 'abstract' | 'native' | 'synchronized' | 'transient' | 'volatile' | 'strictfp' | 'default' | 'sealed' | 'non' '-' 'sealed')*
annotation = '@' qname P:annargs?
annargs = (annarg (',' annarg)*)?
annarg = (ID '=')? annvalue
annvalue = expr | C:annvalues | annotation
annvalues = (annvalue (',' annvalue)* ','?)?
typedecl = mods ('class' ID typeparams? ('extends' type)? ('implements' typelist)? ('permits' typelist)? C:members | 'interface' ID typeparams? ('extends' typelist)? ('permits' typelist)? C:members | '@' 'interface' ID C:members | 'enum' ID ('implements' typelist)? C:enumbody | 'record' ID typeparams? P:params ('implements' typelist)? C:members)
typelist = type (',' type)*
typeparams = '<' typeparam (',' typeparam)* '>'
typeparam = annotation* ID ('extends' type ('&' type)*)?
typeargs = '<' (typearg (',' typearg)*)? '>'
typearg = annotation* ('?' (('extends' | 'super') type)? | type)
type = annotation* (PRIM | ID typeargs? ('.' annotation* ID typeargs?)*) (annotation* S:none)*
none = NOTHING?
member = ';' | 'static'? C:stmts | typedecl | mods typeparams? ID P:params throws? C:stmts | mods ID C:stmts | mods typeparams? ('void' | type) ID P:params (S:none)* throws? (C:stmts | ('default' annvalue)? ';') | mods type declarators ';'
throws = 'throws' typelist
declarators = declarator (',' declarator)*
declarator = ID (S:none)* ('=' init)?
init = expr | C:inits
inits = (init (',' init)* ','?)?
params = (param (',' param)*)?
param = (annotation | 'final')* type annotation* '...'? (ID (S:none)* | (ID '.')? 'this')
enumbody = (constant (',' constant)*)? ','? (';' member*)?
constant = annotation* ID P:args? C:members?
stmt = ';' | C:stmts | (annotation | 'final')* (type | 'var') declarators ';' | typedecl | 'if' P:expr stmt ('else' stmt)? | 'for' P:forhead stmt | 'while' P:expr stmt | 'do' stmt 'while' P:expr ';' | 'return' expr? ';' | ('break' | 'continue') ID? ';' | 'throw' expr ';' | 'yield' expr ';' | 'assert' expr (':' expr)? ';'
 | 'try' P:resources? C:stmts ('catch' P:catch C:stmts)* ('finally' C:stmts)? | 'switch' P:expr C:cases | 'synchronized' P:expr C:stmts | ID ':' stmt | expr ';'
catch = (annotation | 'final')* type ('|' type)* ID
resources = resource (';' resource)* ';'?
resource = 'final'? type ID '=' expr | postfix
forhead = (('final' | annotation)* type declarators | expr (',' expr)*)? ';' expr? ';' (expr (',' expr)*)? | ('final' | annotation)* type ID ':' expr
cases = (('case' label (',' label)* ('when' expr)? | 'default') (':' stmt* | '->' (C:stmts | 'throw' expr ';' | expr ';')))*
label = type ID | expr | 'default' | type P:patterns ID?
patterns = (label (',' label)*)?
expr = place assignop expr | bin ('?' expr ':' expr)? | lambda
place = ID | primary tail* ('.' ID | S:expr) | P:place
assignop = '=' | '+=' | '-=' | '*=' | '/=' | '%=' | '&=' | '|=' | '^=' | '<<=' | '>' '>=' | '>' '>' '>='
lambda = (ID | P:params | P:ids) '->' (C:stmts | expr)
ids = (ID (',' ID)*)?
bin = operand (binop operand | 'instanceof' 'final'? (type ID? | type P:patterns))*
binop = '+' | '-' | '*' | '/' | '%' | '&' | '|' | '^' | '<<' | '>' '>' | '>' '>' '>' | '==' | '!=' | '<' | '>' | '<=' | '>=' | '&&' | '||'
operand = lambda | ('!' | '-' | '+' | '~' | '++' | '--')* postfix | ('!' | '-' | '+' | '~')* P:cast operand
cast = type ('&' type)*
postfix = primary tail*
tail = '.' typeargs? (ID | 'class' | 'this' | 'super' | new) | P:args | S:expr | '++' | '--' | '::' typeargs? (ID | 'new')
primary = ID | NUM | STR | 'this' | 'super' | 'null' | 'true' | 'false' | P:expr | new | type '::' (ID | 'new') | type '.' 'class' | 'void' '.' 'class' | 'switch' P:expr C:cases
new = 'new' annotation* (PRIM | ID typeargs? ('.' ID typeargs?)*) (P:args C:members? | (S:expr)+ (S:none)* | (S:none)+ C:inits)
args = (expr (',' expr)*)?
"""

RUST = """
top = item | MACRO
item = attr* vis? itembody | attr* MACRO ';'?
attr = '#' '!'? S:any
vis = 'pub' P:any?
itembody = 'use' usetree ';' | 'mod' ID (';' | C:items) | 'extern' 'crate' (ID | 'self') ('as' ID)? ';' | fn | 'struct' ID generics? (where? C:fields | P:tuple where? ';' | ';') | 'union' ID generics? where? C:fields | 'enum' ID generics? where? C:variants | 'unsafe'? 'impl' generics? 'const'? '!'? type ('for' type)? where? C:items | 'unsafe'? 'auto'? 'trait' ID generics? (':' bounds?)? where? C:items
 | 'const' (ID) ':' type ('=' expr)? ';' | 'static' 'mut'? ID ':' type ('=' expr)? ';' | 'type' ID generics? (':' bounds?)? where? ('=' type)? where? ';' | 'unsafe'? 'extern' STR? C:items | ';'
usetree = '::'? (path1 '::')? (C:usetrees | '*') | '::'? path1 ('as' ID)?
path1 = seg1 ('::' seg1)*
seg1 = ID | 'crate' | 'self' | 'super' | 'Self'
usetrees = (usetree (',' usetree)* ','?)?
fn = ('const' | 'async' | 'unsafe' | 'extern' STR?)* 'fn' ID generics? P:params ('->' type)? where? (C:stmts | ';')
generics = '<' (gparam (',' gparam)* ','?)? '>'
gparam = attr* (LIFE (':' (LIFE ('+' LIFE)*)?)? | ID (':' bounds?)? ('=' type)? | 'const' ID ':' type ('=' primary)?)
bounds = bound ('+' bound)* '+'?
bound = LIFE | '?'? ('for' generics)? type | P:bound
where = 'where' (wherep (',' wherep)* ','?)?
wherep = LIFE ':' bounds? | ('for' generics)? type ':' bounds?
params = (param (',' param)* ','?)?
param = attr* ('&' LIFE? )? 'mut'? 'self' (':' type)? | attr* pattern ':' type | '...'
fields = (field (',' field)* ','?)?
field = attr* vis? ID ':' type
tuple = (attr* vis? type (',' attr* vis? type)* ','?)?
variants = (variant (',' variant)* ','?)?
variant = attr* vis? ID (P:tuple | C:fields)? ('=' expr)?
type = '&' LIFE? 'mut'? type | '&&' LIFE? 'mut'? type | '*' ('const' | 'mut') type | S:arraytype | P:types | ('unsafe' | 'extern' STR?)* 'fn' P:fnparams ('->' type)? | ('dyn' | 'impl') bounds | '!' | '_' | ('for' generics) type | '<' type ('as' type)? '>' ('::' tseg)+ | '::'? tseg ('::' tseg)* | MACRO
tseg = (ID | 'crate' | 'self' | 'super' | 'Self') ('::'? typeargs | P:types ('->' type)?)?
typeargs = '<' (typearg (',' typearg)* ','?)? '>'
typearg = LIFE | ID '=' type | ID ':' bounds | type | NUM | STR | C:stmts | '-' NUM | 'true' | 'false'
arraytype = type (';' expr)?
types = (type ('+' bounds)? (',' type)* ','?)?
fnparams = ((ID ':')? type (',' (ID ':')? type)* ','?)?
pattern = '|'? pat1 ('|' pat1)*
pat1 = 'ref'? 'mut'? ID ('@' pat1)? | '_' | '..' | literal ('..=' literal? | '..' literal?)? | ('..=' | '..') literal | '&' 'mut'? pat1 | '&&' pat1 | P:patterns | S:patterns | path P:patterns | path C:fieldpats | path ('..=' path)? | MACRO | 'const' C:stmts
literal = '-'? NUM | STR | 'true' | 'false' | path
patterns = (pattern (',' pattern)* ','?)?
fieldpats = (fieldpat (',' fieldpat)* ','?)?
fieldpat = attr* ('..' | (ID | NUM) ':' pattern | 'ref'? 'mut'? ID)
path = '::'? seg ('::' seg)* | '<' type ('as' type)? '>' ('::' seg)+
seg = (ID | 'crate' | 'self' | 'super' | 'Self') | typeargs
stmt = ';' | attr* 'let' pattern (':' type)? ('=' expr ('else' C:stmts)?)? ';' | item | attr* blockexpr | attr* expr ';' | MACRO
last = stmt* (attr* expr)?
expr = attr* bin
bin = range (binop range)*
range = operand (('..' | '..=') operand?)? | ('..' | '..=') operand?
binop = '+' | '-' | '*' | '/' | '%' | '&' | '|' | '^' | '<<' | '>' '>' | '==' | '!=' | '<' | '>' | '<=' | '>=' | '&&' | '||' | '=' | '+=' | '-=' | '*=' | '/=' | '%=' | '&=' | '|=' | '^=' | '<<=' | '>' '>='
operand = ('!' | '-' | '*' | '&' 'mut'? | '&&' 'mut'? | '&' 'raw' ('const' | 'mut'))* postfix | closure | ('return' | 'break' LIFE?) expr? | 'continue' LIFE? | 'yield' expr?
closure = ('static' | 'async' | 'move')* ('||' | '|' (cparam (',' cparam)* ','?)? '|') ('->' type C:stmts | expr)
cparam = pat1 (':' type)?
postfix = primary (tail | 'as' type)*
tail = '.' (ID ('::' typeargs)? | NUM | 'await') | P:args | S:expr | '?'
primary = NUM | STR | 'true' | 'false' | blockexpr | path C:inits | path | P:tuplex | S:arrayx | MACRO | '_'
blockexpr = (LIFE ':')? ('unsafe' | 'async' 'move'? | 'const')? C:stmts | 'if' cond C:stmts ('else' 'if' cond C:stmts)* ('else' C:stmts)? | 'match' expr C:arms | (LIFE ':')? ('loop' C:stmts | 'while' cond C:stmts | 'for' pattern 'in' expr C:stmts)
cond = condpart ('&&' condpart)*
condpart = 'let' pattern '=' expr | expr
arms = arm* lastarm?
arm = attr* pattern ('if' cond)? '=>' (blockexpr ','? | expr ',')
lastarm = attr* pattern ('if' cond)? '=>' expr
args = (expr (',' expr)* ','?)?
tuplex = (expr (',' expr)* ','?)?
arrayx = (expr (';' expr | (',' expr)* ','?))?
inits = ((init (',' init)* ','?)? ('..' expr?)?)
init = attr* ((ID | NUM) ':' expr | ID)
any = NOTHING?
"""

PYTHON = """
stmt = NL | simple (';' simple)* ';'? NL | compound
suite = NL B:stmts | simple (';' simple)* ';'? NL
simple = 'pass' | 'break' | 'continue' | 'return' stars? | 'raise' (expr ('from' expr)?)? | ('global' | 'nonlocal') ID (',' ID)* | 'del' dtarget (',' dtarget)* ','? | 'assert' expr (',' expr)? | import | 'type' ID S:tparams? '=' expr | assignment
import = 'import' dotted ('as' ID)? (',' dotted ('as' ID)?)* | 'from' ('.' | '...')* dotted? 'import' ('*' | P:names | name (',' name)*)
dotted = ID ('.' ID)*
name = ID ('as' ID)?
names = name (',' name)* ','?
assignment = (targets0 '=')+ rhs | (ID | member | P:single) augop rhs | (ID | member | P:single) ':' expr ('=' rhs)? | rhs
single = ID | member | P:single
member = 'await'? primary tail* ('.' ID | S:slices)
tprim = ID | member | P:tgroup | S:tgroup
tgroup = targets0?
augop = '+=' | '-=' | '*=' | '/=' | '//=' | '%=' | '@=' | '&=' | '|=' | '^=' | '>>=' | '<<=' | '**='
rhs = 'yield' ('from' expr | stars?) | stars
dtarget = ID | member | P:dgroup | S:dgroup
dgroup = (dtarget (',' dtarget)* ','?)?
stars = star (',' star)* ','?
star = '*' bin | named
named = ID ':=' expr | expr
expr = lambda | or ('if' or 'else' expr)?
lambda = 'lambda' lparams ':' expr
lparams = ((ID (',' ID)* (',' '/' (',' ID)*)? (',' lgiven)* | ID (',' ID)* (',' lgiven)* ',' '/' (',' lgiven)* | lgiven (',' lgiven)* (',' '/' (',' lgiven)*)?) (',' lrest)? ','? | lrest ','?)?
lgiven = ID '=' expr
lrest = ('*' ID | '*' ',' (ID | lgiven)) (',' (ID | lgiven))* (',' '**' ID)? | '**' ID
or = not (('and' | 'or') not)*
not = 'not'* cmp
cmp = bin (cmpop bin)*
cmpop = '<' | '>' | '==' | '>=' | '<=' | '!=' | 'in' | 'not' 'in' | 'is' 'not'?
bin = unary (binop unary)*
binop = '+' | '-' | '*' | '/' | '//' | '%' | '@' | '&' | '|' | '^' | '<<' | '>>' | '**'
unary = ('+' | '-' | '~')* 'await'? primary tail*
tail = '.' ID | P:args | S:slices
primary = ID | NUM | STR+ | 'None' | 'True' | 'False' | '...' | P:group | S:list | C:dictset
group = (('yield' ('from' expr | stars?)) | named comp | stars)?
list = (named comp | stars)?
dictset = ((expr ':' expr | '**' bin) (',' (expr ':' expr | '**' bin))* ','? | expr ':' expr comp | named comp | stars)?
comp = ('async'? 'for' targets0 'in' or ('if' or0)*)+
or0 = ID ':=' or | or | lambda
targets0 = tstar (',' tstar)* ','?
tstar = '*'? tprim
args = cargs | named comp
cargs = (arg (',' arg)* (',' karg)* (',' kkarg)* ','? | karg (',' karg)* (',' kkarg)* ','? | kkarg (',' kkarg)* ','?)?
arg = '*' expr | named
karg = ID '=' expr | '*' expr
kkarg = ID '=' expr | '**' expr
slices = slice (',' slice)* ','?
slice = expr? ':' expr? (':' expr?)? | star
compound = 'if' named ':' suite ('elif' named ':' suite)* ('else' ':' suite)? | 'while' named ':' suite ('else' ':' suite)? | 'async'? 'for' targets0 'in' stars ':' suite ('else' ':' suite)? | 'async'? 'with' (P:withitems | witem (',' witem)*) ':' suite
 | 'try' ':' suite (('except' ('*'? stars ('as' ID)?)? ':' suite)+ ('else' ':' suite)? ('finally' ':' suite)? | 'finally' ':' suite) | ('@' named NL)* ('async'? 'def' ID S:tparams? P:params ('->' expr)? ':' suite | 'class' ID S:tparams? P:cargs? ':' suite) | 'match' stars ':' NL B:cases
withitems = witem (',' witem)* ','?
witem = expr ('as' tstar)?
cases = ('case' casepat ('if' named)? ':' suite)+
casepat = pat (',' pat)* ','?
pat = '*' ID | pat1 ('|' pat1)* ('as' ID)?
pat1 = '-'? NUM (('+' | '-') NUM)? | STR+ | 'None' | 'True' | 'False' | dotted P:patargs? | P:pats | S:pats | C:dictpats
patargs = ((ID '=')? pat (',' (ID '=')? pat)* ','?)?
pats = casepat?
dictpats = (dictpat (',' dictpat)* ','?)?
dictpat = pat1 ':' pat | '**' ID
tparams = tparam (',' tparam)* ','?
tparam = ('*' | '**')? ID (':' expr)? ('=' expr)?
params = ((plain (',' plain)* (',' '/' (',' plain)*)? (',' given)* | plain (',' plain)* (',' given)* ',' '/' (',' given)* | given (',' given)* (',' '/' (',' given)*)?) (',' rest)? ','? | rest ','?)?
plain = ID (':' expr)?
given = ID (':' expr)? '=' expr
rest = ('*' ID (':' ('*' bin | expr))? | '*' ',' (plain | given)) (',' (plain | given))* (',' '**' plain)? | '**' plain
"""


def _cut_go(seq):
    out, piece = [], []
    for token in seq:
        piece.append(token)
        if token == ";":
            # for, if and switch headers hold semicolons of their own
            if _open_header(piece):
                continue
            out.append(tuple(piece))
            piece = []
    if piece:
        out.append((*piece, ";"))  # the last semicolon of a list may be left out
    return out


def _open_header(piece):
    starts = [k for k, t in enumerate(piece) if t in ("for", "if", "switch") and (k == 0 or piece[k - 1] in (";", "else", ":"))]
    return bool(starts) and not any(type(t) is tuple and t[0] == "C" for t in piece[starts[-1] :])


_JS_AFTER = {"else", "catch", "finally", "while", ".", "?.", ",", ";", ")", "=", "=>", "?", ":", "in", "of", "instanceof", "as", "satisfies", "from"}


def _cut_js(seq):
    out, piece = [], []
    for k, token in enumerate(seq):
        piece.append(token)
        follow = seq[k + 1] if k + 1 < len(seq) else None
        if token in (";", "ASI") and follow not in ("else", "catch", "finally", "while"):
            out.append(tuple(piece))
            piece = []
    if piece:
        out.append((*piece, "ASI"))
    return out


_BLOCK_AFTER = {"else", "catch", "finally", "while", ".", ",", ";", "?", "as", "=", "::", "->"}


def _cut_block(seq):
    """After a semicolon, and after a braced group that nothing goes on from."""
    out, piece = [], []
    for k, token in enumerate(seq):
        piece.append(token)
        follow = seq[k + 1] if k + 1 < len(seq) else None
        if token == ";" and follow not in ("else",) or type(token) is tuple and token[0] == "C" and follow is not None and (type(follow) is tuple and follow[0] == "C" or (type(follow) is str and (follow in _ITEM_WORDS or follow in ("ID", "#", "@", "MACRO", "PRIM")))) and not _header_before(piece):
            out.append(tuple(piece))
            piece = []
    if piece:
        out.append(tuple(piece))
    return out


_ITEM_WORDS = set("pub fn use mod struct enum impl trait const static type unsafe extern let if for while loop match return public private protected final abstract class interface import package void try switch throw do break continue synchronized new this super var record".split())


def _header_before(piece):
    """Whether the braces just read are a struct literal or the like within a statement that goes on."""
    return len(piece) > 1 and piece[0] in ("let", "return") or "=" in piece[:-1] and piece[0] not in ("pub", "fn", "impl", "if", "for", "while", "match", "class", "public", "private", "protected", "static", "final", "@") or (piece[0] == "static" and "=" in piece)


_PY_GOES_ON = {"elif", "else", "except", "finally"}


def _cut_python(seq):
    out, piece = [], []
    for k, token in enumerate(seq):
        piece.append(token)
        follow = seq[k + 1] if k + 1 < len(seq) else None
        ends = token == "NL" or type(token) is tuple and token[0] == "B"
        if ends and not (type(follow) is tuple and follow[0] == "B") and follow not in _PY_GOES_ON and not (piece[0] == "@" and not ({"def", "class"} & set(t for t in piece if type(t) is str))):
            out.append(tuple(piece))
            piece = []
    if piece:
        out.append(tuple(piece))
    return out


#: Words that are keywords in places and names elsewhere: they fit both.
CONTEXTUAL = {
    "python": {"match", "case", "type"},
    "javascript": {"async", "get", "set", "static", "of", "as", "from", "meta", "target"},
    "typescript": {"async", "get", "set", "static", "of", "as", "from", "type", "interface", "implements", "declare", "namespace", "module", "global", "abstract", "public", "private", "protected", "readonly", "is", "keyof", "unique", "infer", "satisfies", "override", "accessor", "asserts", "out"},
    "go": set(), "json": set(),
    "java": {"module", "open", "requires", "exports", "opens", "uses", "provides", "transitive", "to", "with", "var", "record", "sealed", "permits", "yield", "when", "non"},
    "rust": {"union", "auto", "raw", "_", "default", "yield"},
}


def grammar(language: str) -> tuple[Grammar, str]:
    """The grammar and the rule of a whole file."""
    text, lists, cut, start = {
        "json": (JSON, {}, None, "text"),
        "go": (GO + "tops1 = top*\nstmts1 = stmt*\n", {"file": "tops1", "stmts": "stmts1"}, _cut_go, "file"),
        "javascript": (JS + "stmts1 = stmt*\nmembers1 = (member | ASI)*\n", {"stmts": "stmts1", "members": "members1"}, _cut_js, "stmts"),
        "typescript": (TS + "stmts1 = stmt*\nmembers1 = (member | ASI)*\n", {"stmts": "stmts1", "members": "members1"}, _cut_js, "stmts"),
        "java": (JAVA + "tops1 = top*\nstmts1 = stmt*\nmembers1 = member*\n", {"file": "tops1", "stmts": "stmts1", "members": "members1"}, _cut_block, "file"),
        "rust": (RUST + "tops1 = top*\n", {"file": "tops1", "items": "tops1", "stmts": "last"}, _cut_block, "file"),
        "python": (PYTHON + "stmts1 = stmt*\n", {"stmts": "stmts1"}, _cut_python, "stmts"),
    }[language]
    made = Grammar(text, lists, cut)
    made.keywords = WORDS[language]
    made.prepare()
    return made, start
