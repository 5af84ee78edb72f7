"""Productions of the languages that problem 5 checks; the notation is that of `grammar`. -- begins a comment.

Classes of tokens: ID name, NUM number, STR string (and character), BIN operator between operands, PRE before one,
PM + and -, INC ++ and --, ASG assignment with an operation.
"""

from __future__ import annotations

from functools import lru_cache

from edgewright.llm.grammar import Grammar

_JS = """
file = {stmt} ;
block = {stmt} ;
stmt = ';' | b.block | decl ';' | 'if' p.expr stmt ['else' stmt] | 'for' ['await'] p.forhead stmt | 'while' p.expr stmt | 'with' p.expr stmt
  | 'do' stmt 'while' p.expr [';'] | ('break' | 'continue') [name] ';' | 'return' [expr] ';' | 'throw' expr ';'
  | 'try' b.block ('catch' [p.caught] b.block ['finally' b.block] | 'finally' b.block) | 'switch' p.expr b.cases | 'debugger' ';'
  | name ':' stmt | declared | import | export | sexpr ';' | more ;
declared = ['async'] 'function' ['*'] name sig body | class ;
body = b.block ;
decl = ('var' | 'let' | ['await'] 'using') binding {',' binding} | 'const' fixed {',' fixed} ;
binding = name [definite] ann ['=' assign] | pattern ann '=' assign ;
fixed = (name | pattern) ann '=' assign ;
pattern = s.array | b.object ;
target = name | pattern ;
caught = target ann ;
forhead = [('var' | 'let') init {',' init} | 'const' fixed {',' fixed} | expr] ';' [expr] ';' [expr]
  | ('var' | 'let' | 'const' | ['await'] 'using') target ann ('of' assign | 'in' expr) | place ('of' assign | 'in' expr) ;
init = target ann ['=' assign] ;
cases = {'case' expr ':' {stmt} | 'default' ':' {stmt}} ;
sig = tparams p.params rann ;
class = {deco} 'class' [name] tparams ['extends' primary {tail}] implements b.classbody ;
deco = DECO [p.args] | '@' p.expr ;
classbody = {member} ;
member = ';' | {deco} {mod} pname mark ann ['=' assign] ';' | {deco} {mod} ['async'] ['*'] pname mark sig mbody | {deco} {mod} ('get' | 'set') pname sig mbody
  | 'static' b.block | indexed ;
mod = 'static' | 'accessor' ;
mbody = b.block ;
import = 'import' STR [with] ';' | 'import' ['type'] (name [',' (b.names | '*' 'as' name)] | b.names | '*' 'as' name) 'from' STR [with] ';' ;
with = ('with' | 'assert') b.object ;
names = [spec {',' spec} [',']] ;
spec = ['type'] (word | STR) ['as' (word | STR)] ;
export = {deco} 'export' (['type'] '*' ['as' (word | STR)] 'from' STR [with] ';' | ['type'] b.names ['from' STR [with]] ';' | decl ';' | declared
  | 'default' (['async'] 'function' ['*'] [name] sig body | class | assign ';') | more) ;
expr = assign {',' assign} ;
assign = place asgop assign | cond | arrow | yield ;
cond = bin ['?' assign ':' assign] ;
bin = unary {binop unary | as} ;
unary = {preop} primary {tail} [INC] ;
preop = PRE | 'typeof' | 'void' | 'delete' | '!' | PM | INC | 'await' | 'new' ;
binop = BIN | PM | '*' | '|' | '&' | '<' | '>' ['>' ['>']] | 'in' | 'instanceof' ;
asgop = '=' | ASG ;
place = pattern | name | p.place | primary {tail} ('.' (ID | PRIV) | s.expr | nonnull) ;
arrow = ['async'] (name | tparams p.params rann) '=>' (b.block | assign) ;
yield = 'yield' ['*'] [assign] ;
sexpr = sassign {',' assign} ;
sassign = splace asgop assign | sbin ['?' assign ':' assign] | arrow | yield ;
splace = name | s.array | p.place | plain {tail} ('.' (ID | PRIV) | s.expr | nonnull) ;
sbin = sunary {binop unary | as} ;
sunary = preop unary | plain {tail} [INC] ;
plain = name | NUM | STR | TPL | t.parts | 'this' | 'super' | 'null' | 'true' | 'false' | s.array | p.expr | PRIV | 'import' (p.args | '.' ID) | 'new' '.' ID | cast ;
primary = plain | b.object | ['async'] 'function' ['*'] [name] sig b.block | class ;
tail = '.' (ID | PRIV) | '?.' (ID | PRIV | p.args | s.expr) | s.expr | p.args | TPL | t.parts | nonnull ;
parts = {expr ','} ;
args = [arg {',' arg} [',']] ;
arg = ['...'] assign ;
array = [arg] {',' [arg]} ;
object = [prop {',' prop} [',']] ;
prop = '...' assign | pname ':' assign | name ['=' assign] | ['async'] ['*'] pname sig b.block | ('get' | 'set') pname sig b.block ;
pname = word | STR | NUM | s.expr | PRIV ;
params = [param {',' param} [',']] ;
param = {deco} {pmod} ['...'] target opt ann ['=' assign] | 'this' ann ;
word = name | 'if' | 'else' | 'for' | 'while' | 'do' | 'with' | 'break' | 'continue' | 'return' | 'throw' | 'try' | 'catch' | 'finally' | 'switch' | 'case' | 'default' | 'debugger'
  | 'function' | 'class' | 'var' | 'const' | 'new' | 'in' | 'instanceof' | 'this' | 'super' | 'null' | 'true' | 'false' | 'import' | 'export' | 'extends' | 'typeof' | 'void' | 'delete' | 'enum' ;
"""
_JS_ONLY = """
name = ID | 'async' | 'await' | 'of' | 'get' | 'set' | 'static' | 'accessor' | 'from' | 'as' | 'let' | 'yield' | 'using' | 'type' | 'assert' ;
definite = ; ann = ; rann = ; tparams = ; implements = ; mark = ; pmod = ; opt = ; nonnull = NEVER ; cast = NEVER ; as = NEVER ; indexed = NEVER ; more = NEVER ;
"""
_TS = """
name = ID | 'async' | 'await' | 'of' | 'get' | 'set' | 'static' | 'accessor' | 'from' | 'as' | 'let' | 'yield' | 'using' | 'type' | 'assert' | 'readonly' | 'private' | 'protected' | 'public'
  | 'abstract' | 'declare' | 'namespace' | 'module' | 'keyof' | 'infer' | 'is' | 'asserts' | 'override' | 'satisfies' | 'unique' | 'global' | 'implements' | 'out' | 'interface' ;
ann = [':' type] ;
rann = [':' type] ;
definite = '!' ;
tparams = ['<' tparam {',' tparam} [','] '>'] ;
tparam = {'const' | 'in' | 'out'} name ['extends' type] ['=' type] ;
implements = ['implements' type {',' type}] ;
mark = ['?' | '!'] ;
opt = ['?'] ;
pmod = 'public' | 'private' | 'protected' | 'readonly' | 'override' ;
mod = 'static' | 'accessor' | 'public' | 'private' | 'protected' | 'readonly' | 'abstract' | 'declare' | 'override' ;
body = b.block | ';' ;
mbody = b.block | ';' ;
nonnull = '!' ;
cast = '<' type '>' unary ;
as = ('as' | 'satisfies') (type | 'const') ;
fixed = (name | pattern) ann ['=' assign] ;
tail = '.' (ID | PRIV) | '?.' (ID | PRIV | ['<' types '>'] p.args | s.expr) | s.expr | p.args | TPL | t.parts | '!' | '<' types '>' ;
indexed = {mod} s.mapped ann ';' ;
more = ['declare'] ('type' name tparams '=' type ';' | 'interface' name tparams ['extends' types] b.typebody | ['const'] 'enum' name b.enumbody
  | ('namespace' | 'module') (name {'.' ID} | STR) (b.block | ';') | 'global' b.block | 'abstract' class)
  | 'declare' (decl ';' | declared) | {deco} 'abstract' class | 'import' ['type'] name '=' (primary {tail}) ';' | '=' expr ';' | 'as' 'namespace' name ';' | 'default' ('abstract' class | 'interface' name tparams ['extends' types] b.typebody) ;
types = type {',' type} [','] ;
type = union ['extends' union '?' type ':' type] | ('asserts' (name | 'this') | name | 'this') 'is' type | 'asserts' (name | 'this') ;
union = ['|' | '&'] post {('|' | '&') post} ;
post = {'keyof' | 'readonly' | 'unique' | 'infer'} base {s.within} ['extends' base {s.within}] ;
within = [type] ;
base = name {'.' ID} ['<' types '>'] | STR | NUM | PM NUM | TPL | t.typeparts | 'this' | 'void' | 'null' | 'true' | 'false' | p.type | b.typebody | s.tuple | 'typeof' (name | 'this' | 'import' p.args) {'.' (ID | PRIV)} ['<' types '>']
  | ['abstract'] ['new'] tparams p.params '=>' type | 'import' p.args {'.' ID} ['<' types '>'] ;
typeparts = {type ','} ;
tuple = [telem {',' telem} [',']] ;
telem = ['...'] [word ['?'] ':'] type ['?'] ;
typebody = {[tmember] (',' | ';')} [tmember] ;
tmember = {'readonly' | PM 'readonly'} (s.mapped [PM] ['?'] ann | pname ['?'] ann) | ('get' | 'set') pname sig | pname ['?'] sig | ['new'] sig ;
deco = DECO ['<' types '>'] [p.args] | '@' p.expr ;
mapped = name ':' type | name 'in' type ['as' type] | expr ;
enumbody = [emember {',' emember} [',']] ;
emember = (word | STR | s.expr) ['=' assign] ;
"""
_RS = """
file = {inner} {item} ;
items = {inner} {item} ;
mac = ['::'] {seg '::'} MACRO ;
inner = '#' '!' s.nothing ;
outer = '#' s.nothing ;
nothing = ;
vis = 'pub' [p.path] ;
path = 'in' usepath | 'crate' | 'super' | 'self' ;
usepath = ['::'] seg {'::' seg} ;
item = {outer} [vis] kind | {outer} mac [ID] (b.nothing [';'] | (p.nothing | s.nothing) ';') ;
kind = 'use' usetree ';' | 'mod' id (';' | b.items) | fn | 'struct' id generics structrest | 'enum' id generics where b.variants | 'union' id generics where b.fields
  | ['unsafe'] ['auto'] 'trait' id generics [':' [bounds]] where (b.items | '=' bounds ';') | ['default'] ['unsafe'] 'impl' generics ['const'] ['!'] type ['for' type] where b.items
  | 'const' (id | '_') [':' type] ['=' expr] ';' | 'static' ['mut'] id ':' type ['=' expr] ';' | ['default'] 'type' id generics [':' [bounds]] where ['=' type] where ';'
  | 'extern' 'crate' (id | 'self') ['as' (id | '_')] ';' | ['unsafe'] 'extern' [STR] b.items ;
fn = {'const' | 'async' | 'unsafe' | 'default' | 'safe' | 'extern' [STR]} 'fn' id generics p.fnparams ['->' type] where (b.block | ';') ;
generics = ['<' [gparam {',' gparam} [',']] '>'] ;
gparam = {outer} (LIFE [':' [bounds]] | id [':' [bounds]] ['=' type] | 'const' id ':' type ['=' (b.block | ['-'] literal | id)]) ;
bounds = bound {'+' bound} ['+'] ;
bound = LIFE | p.bounds | ['?' | '~' 'const' | 'async'] [forlife] tpath | 'use' '<' [gargs] '>' ;
forlife = 'for' '<' [gparam {',' gparam} [',']] '>' ;
where = ['where' [wpred {',' wpred} [',']]] ;
wpred = (LIFE | [forlife] type) ':' [bounds] ;
structrest = where (b.fields | ';') | p.tfields where ';' ;
fields = [field {',' field} [',']] ;
field = {outer} [vis] id ':' type ['=' expr] ;
tfields = [{outer} [vis] type {',' {outer} [vis] type} [',']] ;
variants = [variant {',' variant} [',']] ;
variant = {outer} [vis] id [b.fields | p.tfields] ['=' expr] ;
usetree = ['::'] {seg '::'} (seg ['as' (id | '_')] | '*' | b.usetrees) ;
usetrees = [usetree {',' usetree} [',']] ;
seg = id | 'self' | 'Self' | 'super' | 'crate' ;
id = ID | 'union' | 'auto' | 'default' | 'raw' | 'safe' ;
type = '!' | '_' | p.types | s.tarray | ('&' | '&&') [LIFE] ['mut'] type | '*' ('const' | 'mut') type | [forlife] ['unsafe'] ['extern' [STR]] 'fn' p.fnptr ['->' type]
  | ['impl' | 'dyn'] bounds | mac (p.nothing | s.nothing | b.nothing) ;
types = [type {',' type} [',']] ;
tarray = type [';' expr] ;
fnptr = [{outer} [(id | '_') ':'] type {',' {outer} [(id | '_') ':'] type} [',' ['...']]] ;
tpath = ['::'] tseg {'::' tseg} | '<' type ['as' tpath] '>' '::' tseg {'::' tseg} ;
tseg = seg [['::'] '<' [gargs] '>' | ['::'] p.types ['->' type]] ;
gargs = garg {',' garg} [','] ;
garg = LIFE | type | id ['<' [gargs] '>'] ('=' type | ':' bounds) | ['-'] literal | b.block ;
fnparams = [fparam {',' fparam} [',']] ;
fparam = {outer} (['&' [LIFE]] ['mut'] 'self' [':' type] | pat ':' type | '...') ;
block = {inner} {bstmt} [{outer} expr] ;
bstmt = ';' | {outer} 'let' pat [':' type] ['=' expr ['else' b.block]] ';' | item | {outer} expr ';' | {outer} blockexpr | {outer} mac b.nothing ;
blockexpr = [LIFE ':'] (['unsafe' | 'const' | 'async' ['move'] | 'try'] b.block | if | 'match' expr b.arms | 'loop' b.block | 'while' cond b.block | 'for' pat 'in' expr b.block) ;
if = 'if' cond b.block ['else' (if | b.block)] ;
cond = ['let' pat '='] expr {'&&' ['let' pat '='] expr} ;
arms = {inner} {{outer} armhead '=>' (expr ',' | blockexpr [','] | mac b.nothing [','])} [{outer} armhead '=>' expr] ;
armhead = pat ['if' cond] ;
expr = range {asgop range} ;
asgop = '=' | ASG ;
dots = '..' | '...' | DOTS ;
range = bin [dots [bin]] | dots [bin] ;
bin = unary {binop unary} ;
binop = BIN | '-' | '*' | '&' | '&&' | '|' | '||' | '+' | '<' ['<'] | '>' ['>'] ;
unary = {'-' | '*' | '!' | ('&' | '&&') ['mut' | 'raw' ('const' | 'mut')]} operand ;
operand = primary {'?' | '.' (seg ['::' '<' [gargs] '>'] | NUM | 'await') | p.list | s.expr | 'as' type} | closure | ('return' | 'break' [LIFE] | 'yield') [expr] | 'continue' [LIFE] ;
literal = NUM | STR | 'true' | 'false' ;
primary = literal | epath | p.list | s.array | blockexpr | mac (p.nothing | s.nothing | b.nothing) | epath b.sfields ;
epath = ['::'] seg {'::' (seg | '<' [gargs] '>')} | '<' type ['as' tpath] '>' {'::' (seg | '<' [gargs] '>')} | '_' ;
sfields = [sfield {',' sfield} [',']] ;
sfield = {outer} (id [':' expr] | NUM ':' expr | '..' [expr]) ;
list = [{outer} expr {',' {outer} expr} [',']] ;
array = list | expr ';' expr ;
closure = [forlife] ['static'] ['async'] ['move'] ('||' | '|' [cparam {',' cparam} [',']] '|') ('->' type b.block | expr) ;
cparam = {outer} patone [':' type] ;
pat = ['|'] patone {'|' patone} ;
patone = plit [dots [plit]] | dots plit | '..' | '_' | ['ref'] ['mut'] id ['@' patone] | ('&' | '&&') ['mut'] patone | p.pats | s.pats | epath (p.pats | b.pfields) | mac (p.nothing | s.nothing) | 'box' patone | 'const' b.block ;
plit = ['-'] NUM | STR | 'true' | 'false' | epath ;
pats = [pat {',' pat} [',']] ;
pfields = [pfield {',' pfield} [',']] ;
pfield = {outer} ('..' | ['box'] ['ref'] ['mut'] id | id ':' pat | NUM ':' pat) ;
"""
_JAVA = """
file = [{annot} 'package' name {'.' ID} ';'] {import} {type0 | ';'} | {import} {annot} ['open'] 'module' name {'.' ID} b.directives ;
import = 'import' ['static' | 'module'] name {'.' ID} ['.' '*'] ';' | ';' ;
directives = {name {name | 'static' | ID | '.' | ',' | 'transitive'} ';'} ;
type0 = {mod} (class | 'interface' name tparams ['extends' types] ['permits' types] b.classbody | 'enum' name ['implements' types] b.enumbody | 'record' name tparams p.params ['implements' types] b.classbody | '@interface' name b.classbody) ;
class = 'class' name tparams ['extends' type] ['implements' types] ['permits' types] b.classbody ;
mod = annot | MOD | 'static' | 'final' | 'default' | 'synchronized' | 'sealed' | 'non' PM 'sealed' ;
annot = ANN [p.annargs] ;
annargs = [annarg {',' annarg} [',']] ;
annarg = [name '='] elem ;
elem = cond | b.elems | annot ;
elems = [elem {',' elem} [',']] | ',' ;
enumbody = [constant {',' constant}] [','] [';' {member}] ;
constant = {annot} name [p.args] [b.classbody] ;
classbody = {member} ;
member = ';' | type0 | ['static'] b.block | {mod} [tparams1 {annot}] (type | 'void') name p.params {dims} ['throws' types] (b.block | ['default' elem] ';')
  | {mod} [tparams1] name p.params ['throws' types] b.block | {mod} name b.block | {mod} type var {',' var} ';' ;
tparams = [tparams1] ;
tparams1 = '<' tparam {',' tparam} '>' ;
tparam = {annot} name ['extends' type {'&' type}] ;
types = type {',' type} ;
dims = {annot} s.nothing ;
nothing = ;
type = {annot} (PRIM | cname) {dims} ;
cname = name [targs] {'.' {annot} ID [targs]} ;
targs = '<' [targ {',' targ}] '>' ;
targ = type | {annot} '?' [('extends' | 'super') type] ;
var = name {dims} ['=' init] ;
init = expr | b.inits ;
inits = [init {',' init}] [','] ;
params = [param {',' param}] ;
param = {mod} type [{annot} '...'] (name {dims} | [name '.'] 'this' | ID) ;
block = {stmt} ;
stmt = ';' | b.block | {mod} type var {',' var} ';' | type0 | 'if' p.expr stmt ['else' stmt] | 'while' p.expr stmt | 'do' stmt 'while' p.expr ';' | 'for' p.forhead stmt
  | 'switch' p.expr b.switch | 'synchronized' p.expr b.block | 'try' b.block (catch {catch} ['finally' b.block] | 'finally' b.block) | 'try' p.resources b.block {catch} ['finally' b.block]
  | 'return' [expr] ';' | 'throw' expr ';' | ('break' | 'continue') [name] ';' | 'yield' expr ';' | 'assert' expr [':' expr] ';' | name ':' stmt | sexpr ';' ;
catch = 'catch' p.caught b.block ;
caught = {mod} type {'|' type} name ;
resources = resource {';' resource} [';'] ;
resource = {mod} type name '=' expr | primary {tail} ;
forhead = [{mod} type var {',' var} | sexpr {',' sexpr}] ';' [expr] ';' [sexpr {',' sexpr}] | {mod} type name {dims} ':' expr ;
switch = {'case' label {',' label} ['when' expr] ':' {stmt} | 'default' ':' {stmt}}
  | {('case' label {',' label} ['when' expr] | 'default') '->' (expr ';' | b.block | 'throw' expr ';')} ;
label = cond | 'default' | pattern ;
pattern = {mod} type (name | '_') | cname p.patterns [name] ;
patterns = [pattern {',' pattern}] ;
sexpr = place asgop expr | INC unary | primary {tail} INC | primary {tail} p.args | new ;
asgop = '=' | ASG ;
place = name | primary {tail} ('.' ID | s.expr) | p.place ;
expr = lambda | place asgop expr | cond ;
cond = bin ['?' expr ':' (cond | lambda)] ;
bin = unary {binop unary | 'instanceof' (pattern | ['final'] type)} ;
binop = BIN | PM | '*' | '&' | '|' | '<' | '>' ['>' ['>']] ;
unary = {PM | PRE | INC | p.casts} (primary {tail} {INC} | p.casts lambda) ;
casts = type {'&' type} ;
lambda = (name | p.params | p.names) '->' (b.block | expr) ;
names = [name {',' name}] ;
primary = name | NUM | STR | 'true' | 'false' | 'null' | 'this' | 'super' | p.expr | new | 'switch' p.expr b.switch | 'void' '.' ID | (PRIM | name {'.' ID} s.nothing) {dims} ('.' ID | '::' (ID | 'new')) | PRIM '.' ID | cname targs {dims} '::' [targs] (ID | 'new') | name targs '::' [targs] (name | 'new') ;
tail = '.' [targs] ID [targs '::' ('new' | name)] | '.' 'new' {annot} name [targs] p.args [b.classbody] | s.expr | p.args | '::' [targs] (name | 'new') ;
new = 'new' [targs] {annot} (PRIM | cname) (p.args [b.classbody] | dims {dims} b.inits | {annot} s.expr {{annot} s.expr} {dims}) ;
args = [expr {',' expr}] ;
name = ID | 'record' | 'var' | 'yield' | 'permits' | 'sealed' | 'non' | 'when' | 'module' | 'open' | 'transitive' | '_' ;
"""
_GO = """
file = 'package' ID ';' {'import' (import | p.imports) ';'} {decl ';'} ;
import = [ID | '.'] STR ;
imports = [import {';' import} [';']] ;
decl = 'func' [p.params] ID [s.tparams] sig [b.block] | gen ;
gen = 'var' (var | p.vars) | 'const' (const | p.consts) | 'type' (typedef | p.typedefs) ;
sig = p.params [type | p.params] ;
ids = ID {',' ID} ;
var = ids (type ['=' exprs] | '=' exprs) ;
vars = [var {';' var} [';']] ;
const = ids [[type] '=' exprs] ;
consts = [const {';' const} [';']] ;
typedef = ID [s.tparams] ['='] type ;
typedefs = [typedef {';' typedef} [';']] ;
type = ID ['.' ID] [s.types] | inner ;
inner = '*' type | s.length type | 'map' s.one type | 'chan' ['<-'] type | '<-' 'chan' type | 'func' sig | 'struct' b.fields | 'interface' b.methods | p.one ;
one = type ;
types = type {',' type} [','] ;
length = [expr | '...'] ;
fields = [field {';' field} [';']] ;
field = ids type [STR] | ['*'] ID ['.' ID] [s.types] [STR] ;
methods = [method {';' method} [';']] ;
method = ID sig | bounds ;
bounds = ['~'] type {'|' ['~'] type} ;
tparams = ids bounds {',' ids bounds} [','] ;
params = [param {',' param} [',']] ;
param = [ID] ['...'] type ;
block = {[stmt] ';'} [stmt] ;
stmt = gen | ID ':' [stmt] | simple | ('go' | 'defer') call | 'return' [exprs] | ('break' | 'continue') [ID] | 'goto' ID | 'fallthrough' | b.block | if
  | 'for' [[simple] ';' [expr] ';' [simple] | expr | [exprs ('=' | ':=')] 'range' expr] b.block | 'switch' [[simple] ';'] [simple] b.cases | 'select' b.cases ;
if = 'if' [[simple] ';'] expr b.block ['else' (if | b.block)] ;
call = unary ;
simple = exprs [ASG exprs | '=' exprs | INC | '<-' expr] | ids ':=' exprs ;
cases = {('case' caseitem {',' caseitem} [('=' | ':=' | '<-') expr] | 'default') ':' {[stmt] ';'} [stmt]} ;
caseitem = expr | type ;
exprs = expr {',' expr} ;
expr = unary {binop unary} ;
binop = BIN | PM | '*' | '&' | '|' | '^' | '<' | '>' ['>'] ;
unary = {PM | '!' | '^' | '*' | '&' | '<-'} operand {tail} ;
operand = ID | NUM | STR | p.expr | 'func' sig b.block | (ID ['.' ID] [s.types] | s.length type | 'map' s.one type | 'struct' b.fields) b.lit | inner p.args | p.one ;
tail = '.' (ID | p.asserted) | s.index | p.args ;
asserted = type | 'type' ;
index = expr | [expr] ':' [expr] [':' expr] | types ;
args = [arg {',' arg} ['...'] [',']] ;
arg = expr | type ;
lit = [elem {',' elem} [',']] ;
elem = [(expr | b.lit) ':'] (expr | b.lit) ;
"""
_C = """
file = {ext} ;
ext = ';' | specs [inits] ';' | function | 'extern' STR (b.file | ext) | '_Static_assert' p.args ';' | 'asm' p.anything ';' ;
specs = {mod} (TYPE {TYPE | mod} | ID {mod} | record {mod} | mod) ;
mod = MOD | 'static' | 'extern' | '__attribute__' p.anything | '_Alignas' p.anything ;
record = ('struct' | 'union') {mod} (ID [b.fields] | b.fields) | 'enum' {mod} (ID [b.enums] | b.enums) | 'typeof' p.anything ;
inits = init {',' init} ;
init = declarator {mod | 'asm' p.anything} ['=' value] ;
value = assign | b.values ;
values = [elem {',' elem} [',']] ;
elem = [designator {designator} ['='] | ID ':'] value ;
designator = s.index | '.' ID ;
index = cond ['...' cond] ;
declarator = {'*' {mod}} (ID | p.inner) {suffix} ;
inner = {mod} declarator ;
suffix = p.params | s.size ;
size = {mod | 'static'} [assign | '*'] ;
abstract = {'*' {mod}} [p.abstract1] {suffix} ;
abstract1 = '*' {mod} {'*' {mod}} {suffix} | '*' {mod} p.abstract1 {suffix} | s.size {suffix} ;
params = [param {',' param} [',' '...']] ;
param = specs (declarator | abstract) {mod} ;
fields = {specs [bits {',' bits}] ';' | ';' | '_Static_assert' p.args ';'} ;
bits = declarator {mod} [':' cond] {mod} | ':' cond ;
enums = [enum1 {',' enum1} [',']] ;
enum1 = ID {mod} ['=' cond] ;
function = [specs] {'*' {mod}} (ID | p.inner) p.params {mod | suffix} {specs inits ';'} b.block ;
block = {stmt} ;
stmt = ';' | b.block | specs [inits] ';' | ID ':' [stmt] | ('case' cond ['...' cond] | 'default') ':' [stmt] | 'if' p.expr stmt ['else' stmt] | 'switch' p.expr stmt | 'while' p.expr stmt
  | 'do' stmt 'while' p.expr ';' | 'for' p.forhead stmt | 'goto' (ID | '*' unary) ';' | ('break' | 'continue') ';' | 'return' [expr] ';' | expr ';' | 'asm' {mod | 'goto'} p.anything ';' | '_Static_assert' p.args ';' ;
forhead = [expr | specs inits] ';' [expr] ';' [expr] ;
expr = assign {',' assign} ;
assign = unary asgop assign | cond ;
asgop = '=' | ASG ;
cond = bin ['?' [expr] ':' cond] ;
bin = unary {binop unary} ;
binop = BIN | PM | '*' | '&' ;
unary = {PM | PRE | '*' | '&' | INC | 'sizeof' | p.typename} (primary {tail} | ('sizeof' | '_Alignof') p.typename) ;
typename = specs abstract ;
primary = ID | NUM | STR {STR | ID} | CHR | p.expr | p.statements | p.typename b.values | '_Generic' p.anything ;
statements = b.block ;
tail = s.expr | p.args | '.' ID | '->' ID | INC ;
args = [arg {',' arg}] ;
arg = assign | typename ;
anything = ;
"""
_PY = """
file = {stmt} ;
block = stmt {stmt} ;
stmt = simple {';' simple} [';'] NL | compound ;
suite = ':' (NL i.block | simple {';' simple} [';'] NL) ;
compound = 'if' named suite {'elif' named suite} ['else' suite] | 'while' named suite ['else' suite] | ['async'] 'for' targets 'in' stars suite ['else' suite]
  | 'try' suite (handler {handler} ['else' suite] ['finally' suite] | 'finally' suite) | ['async'] 'with' (withitem {',' withitem} | p.withitems) suite
  | {'@' named NL} (['async'] 'def' name [s.tparams] p.params ['->' expr] suite | 'class' name [s.tparams] [p.args] suite) | 'match' stars ':' NL i.cases ;
handler = 'except' ['*'] [expr ['as' name]] suite ;
withitem = expr ['as' target] ;
withitems = withitem {',' withitem} [','] ;
cases = case {case} ;
case = 'case' pats ['if' named] suite ;
simple = 'pass' | 'break' | 'continue' | 'return' [stars] | 'raise' [expr ['from' expr]] | ('global' | 'nonlocal') name {',' name} | 'del' targets | 'assert' expr [',' expr]
  | 'import' dotted ['as' name] {',' dotted ['as' name]} | 'from' ({'.' | '...'} dotted | ('.' | '...') {'.' | '...'}) 'import' ('*' | p.imported | name ['as' name] {',' name ['as' name]})
  | 'type' name [s.tparams] '=' expr | {targets '='} (stars | yield) | single ':' expr ['=' (stars | yield)] | single ASG (stars | yield) ;
imported = name ['as' name] {',' name ['as' name]} [','] ;
dotted = name {'.' name} ;
tparams = tparam {',' tparam} [','] ;
tparam = ['*' | '**'] name [':' expr] ['=' expr] ;
targets = starred {',' starred} [','] ;
starred = ['*'] target ;
single = name | atom {tail} ('.' name | s.slices) | p.single ;
target = single | p.targets0 | s.targets0 ;
targets0 = [targets] ;
stars = star {',' star} [','] ;
star = '*' expr | named ;
named = [name ':='] expr ;
yield = 'yield' ['from' expr | stars] ;
expr = bin ['if' bin 'else' expr] | lambda ;
lambda = 'lambda' [lparam {',' lparam} [',']] ':' expr ;
lparam = ['*' | '**'] name ['=' expr] | '*' | '/' ;
bin = unary {binop unary} ;
binop = BIN | PM | '*' | '**' | '/' | '@' | '|' | 'and' | 'or' | 'in' | 'not' 'in' | 'is' ['not'] ;
unary = {'not' | PM | '~' | 'await'} atom {tail} ;
atom = name | NUM | STR {STR} | '...' | 'None' | 'True' | 'False' | p.paren | s.list | b.set ;
paren = [yield | named comps | star {',' star} [',']] ;
list = [named comps | star {',' star} [',']] ;
set = [named comps | star {',' star} [','] | expr ':' expr comps | item {',' item} [',']] ;
item = expr ':' expr | '**' expr ;
comps = comp {comp} ;
comp = ['async'] 'for' targets 'in' (bin | lambda) {'if' (bin | lambda)} ;
tail = '.' name | s.slices | p.args ;
slices = slice {',' slice} [','] ;
slice = [expr] ':' [expr] [':' [expr]] | named | '*' expr ;
args = [named comps | positional {',' positional} {',' keyword} [','] | keyword {',' keyword} [',']] ;
positional = named | '*' expr ;
keyword = name '=' expr | '*' expr | '**' expr ;
params = [plain | defaults | starting] ;
ann = name [':' expr] ;
plain = ann [',' [plain | defaults | starting | '/' [',' [plain | defaults | starting]]]] ;
defaults = ann '=' expr [',' [defaults | starting | '/' [',' [defaults | starting]]]] ;
starting = '*' name [':' ['*'] expr] [',' [only]] | '*' ',' only | ending ;
only = ann ['=' expr] [',' [only]] | ending ;
ending = '**' ann [','] ;
pats = pat {',' pat} [','] ;
pat = closed {'|' closed} ['as' name] ;
closed = [PM] NUM [PM NUM] | STR {STR} | 'None' | 'True' | 'False' | dotted [p.patargs] | p.pats0 | s.pats0 | b.mapping | '*' name ;
pats0 = [pats] ;
patargs = [patarg {',' patarg} [',']] ;
patarg = [name '='] pat ;
mapping = [mapitem {',' mapitem} [',']] ;
mapitem = closed ':' pat | '**' name ;
name = ID | 'match' | 'case' | 'type' ;
"""
_RB = """
file = block ;
block = {NL} [stmt {NL {NL} stmt} {NL}] ;
body = block {'rescue' [rescued] then block} ['else' block] ['ensure' block] ;
rescued = [carg {',' carg}] ['=>' place] ;
then = NL ['then'] | 'then' ;
stmt = whole {('and' | 'or') whole} {'ifmod' whole {('and' | 'or') whole} | 'rescue' whole} ;
whole = {'not' | '!'} value | lhs {',' lhs} [','] '=' rhs | 'alias' fname fname | 'undef' fname {',' fname} ;
lhs = ['*'] place | p.lhslist ;
lhslist = lhs {',' lhs} [','] ;
place = ID | CONST | VAR | 'self' | primary {tail} (('.' | '&.' | '::') (ID | CONST) | s.args) ;
fname = ID | CONST | SYM | VAR | BIN | PM | '<<' | '<' | '*' | '**' | '|' | '&' | '!' | '~' | s.args ['='] ;
rhs = value {',' ['*'] value} | '*' value {',' ['*'] value} ;
value = place asgop rhs | cond | command ;
asgop = '=' | ASG ;
cond = range ['?' {NL} value ':' {NL} value | '?' {NL} LABEL value | 'in' pattern | '=>' pattern] ;
range = bin [DOTS [bin]] | DOTS bin ;
bin = unary {binop unary} ;
binop = BIN | PM | '*' | '**' | '&' | '|' | '||' | '<' | '<<' | '::' ;
unary = {'!' | PM | '~' | '&' | 'defined?' | 'not'} primary {tail} ;
primary = ID | CONST | VAR | NUM | STR {STR} | SYM | 'self' | 'nil' | 'true' | 'false' | s.args | b.hash | p.block | group | '->' [p.params | params] (b.blockbody | do.blockbody) | '::' CONST
  | ('yield' | 'super') [p.args] | ('return' | 'next' | 'break') [cargs] | 'redo' | 'retry' | EDEF [p.params] '=' stmt ;
group = def.method | class.class | module.module | if.if | while.while | for.for | case.case | begin.body ;
tail = ('.' | '&.') (ID | CONST | LABEL0) [p.args] | ('.' | '&.') p.args | '::' (ID | CONST) [p.args] | s.args | p.args | b.blockbody | do.blockbody ;
command = {'!' | 'not'} (ID | CONST | 'yield' | 'super' | 'defined?' | primary {tail} ('.' | '&.' | '::') (ID | CONST)) cargs [do.blockbody {tail}] ;
cargs = carg {',' {NL} carg} ;
carg = ['*' | '**' | '&'] value | '*' | '**' | '&' | '...' | LABEL {NL} [value] | STR LABEL0 value | range '=>' {NL} value ;
args = {NL} [carg {{NL} ',' {NL} carg} {NL} [','] {NL}] ;
hash = {NL} [pair {{NL} ',' {NL} pair} {NL} [','] {NL}] ;
pair = LABEL {NL} [value] | value '=>' {NL} value | '**' value | STR ':' value ;
blockbody = {NL} ['|' [params] [';' ID {',' ID}] '|' | '||'] body ;
params = {NL} [param {',' {NL} param} [','] {NL}] ;
param = ID ['=' range0] | ('*' | '**' | '&') [ID | 'nil'] | LABEL [range0] | p.params | '...' ;
range0 = arg0 ;
arg0 = unary {BIN unary | PM unary} ;
method = DEF [p.params | params] NL body | DEF p.params body ;
class = ('<<' value | [CONST '::' | '::'] CONST {'::' CONST} ['<' value]) NL body | CONST {'::' CONST} ['<' value] NL body ;
module = ['::'] CONST {'::' CONST} NL body ;
if = whole2 then block {'elsif' whole2 then block} ['else' block] ;
whole2 = whole {('and' | 'or') whole} ;
while = whole2 (NL | 'loopdo') block ;
for = lhs {',' lhs} 'in' value (NL | 'loopdo') block ;
case = [whole2] {NL} {'when' {NL} carg {',' {NL} carg} then block} ['else' block] | [whole2] {NL} 'in' pattern [('ifmod') whole2] then block {'in' pattern [('ifmod') whole2] then block} ['else' block] ;
pattern = pat {',' pat} [','] ;
pat = patone {'|' patone} ['=>' ID] ;
patone = range ['=>' ID] | '*' [ID] | '**' (ID | 'nil') | LABEL [pat] | s.pats | b.pats | (CONST {'::' CONST}) (p.pats | s.pats) | '^' (ID | p.block) | 'nil' ;
pats = {NL} [pat {',' {NL} pat} [','] {NL}] ;
"""


@lru_cache(maxsize=None)
def grammar(lang: str) -> Grammar:
    """The grammar of js, ts, rs, java, go, c, py or rb; made once per process."""
    if lang == "js":
        return Grammar(_JS + _JS_ONLY, {"t": "\x03\x04"}, soft=True)
    if lang == "ts":
        return Grammar(_JS + _TS, {"t": "\x03\x04"}, soft=True)
    if lang == "py":
        return Grammar(_PY, {"i": "\x05\x06"})
    if lang == "rb":
        return Grammar(_RB, {k: chr(0x10 + n) + "\x1f" for n, k in enumerate(("def", "class", "module", "if", "while", "for", "case", "begin", "do"))})
    return Grammar({"rs": _RS, "java": _JAVA, "go": _GO, "c": _C}[lang])
