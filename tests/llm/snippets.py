"""Short texts for problem 5, written for these tests: what each language's grammar derives, and what breaks it."""

VALID = {
    "js": [
        "const q = gql`query { a ${b} c ${`x ${y}`} }`\nconst B = styled.div`a`\n", "a = b\n++c\n", "label: for (;;) { break label }\n", "let {a, b: [c, ...d], ...e} = f\n;[a, b] = [b, a]\n",
        "class A extends B(C) { static #x = 1; #y; static { this.z = 1 } get [k]() { return this.#y } *gen() { yield* other() } async *ag() {} 'str'() {} 12() {} static async m() {} }\n",
        "for await (const x of y) z(x)\nfor (var i = 0, n = a.length; i < n; i++);\nfor (const k in o) if (k) continue; else break\n", "x = a ? b : c ? d : e\nif (a) b\nelse if (c) d\nelse { e }\n", "do x++; while (x < 3) y()\n",
        "export default async function () {}\nexport * as ns from './a'\nexport { a as default, b }\nimport d, * as e from 'f'\nimport './g'\nimport { default as h } from 'i'\n", "const f = async ({a = 1, b}, [c], ...rest) => ({ ...a, [b]: c, get x() { return 1 }, async y() {} })\n",
        "switch (a) { case 1: case 2: b(); break; default: c() }\n", "a?.b?.[c]?.(d) ?? e\na ||= b; a &&= c; a ??= d; a **= 2\n", "var r = /[/\\]]+/gi.test(s), t = a / b / c\nif (x) /re/.exec(y)\n", "throw new Error(`bad ${x}`)\n", "new Foo\nnew a.b.C(1).d()\nnew.target\n",
        "(function () { 'use strict' })()\n!function () {}()\nvoid 0\n", "a = b\n(c)\n", "async () => { await x; for await (y of z) {} }\nvar async = 1, of = 2, get = 3\nasync(of)\n", "o = { if: 1, class: 2, new() {}, get: 1, set() {}, async: 2, 'a-b': 3, 1: 4, }\no.default.delete.if\n",
        "try { a } catch { b } finally { c }\ntry { a } finally { b }\n", "if (a) { } else { }\n{ let b }\n;\n", "x = y\n/* c */ z()\n", "import('x').then(m => m.default)\nimport.meta.url\n", "a = function* named() { const x = yield; yield x }\n", "#!/usr/bin/env node\nwith (a) b\ndebugger\n", "let x = a in b, y = c instanceof D, z = -(-1) ** 2, w = typeof void 0\n", "a\n.b()\n.c()\n", "delete a[b], c\n",
    ],
    "ts": [
        "type A<T extends object = {}> = { readonly [K in keyof T]?: T[K] } & Partial<Record<string, Array<Map<string, number>>>>\n", "function f<T>(this: Window, a: T, b?: number, ...c: string[]): asserts a is NonNullable<T> {}\nfunction g(x: string): void\nfunction g(x: any) { return x as unknown as string[] }\n",
        "abstract class A<T> extends B<T> implements C, D<E> { private readonly x!: number; static y?: string = 'a'; constructor(public a: string, private readonly b = 1) { super() } abstract m(): void; get z(): number { return 1 } [key: string]: any; declare q: string; override n<U>(u: U) {} }\n",
        "enum E { A = 1, B = A << 2, C = 'c', 'd' = 4 }\nconst enum F { X }\ndeclare enum G { }\n", "declare module 'x' { export function f(a: number): string; export default f }\nnamespace N.M { export const a = 1 }\ndeclare global { interface Window { a: 1 } }\n", "type F = new (...args: any[]) => object\ntype G = (a: number, b?: string) => a is string\ntype H = typeof import('x')\ntype I = T extends (infer U)[] ? U : never\n",
        "let x = <T,>(a: T) => a\nlet y = a!.b!()!.c\nlet z = a satisfies B\nlet t: [a: string, b?: number, ...c: boolean[]]\n", "@Component({ a: 1 })\nexport class A { @Input() b: string; @Output() c = new E<string>(); @HostListener('x', ['$event']) d(e) {} }\n", "import type { A } from 'a'\nimport { type B, C } from 'b'\nexport type { D } from 'd'\nimport E = require('e')\nexport = F\n", "interface A extends B, C<D> { (x: number): string; new (x: string): A; m?(): void; readonly [k: string]: unknown; get a(): number }\n",
        "type T = `a-${string}` | 'b' | -1 | null | undefined | void | unique symbol\ntype U = keyof typeof x\ntype V = A['b'][number]\n", "const f = async <T>(x: T): Promise<T[]> => { return [x] }\nfor (const [k, v] of Object.entries(o) as [string, number][]) {}\n", "export default interface A { b: string, c: number }\nexport abstract class Q {}\n", "let a = b as const\nlet c = <any>d\ntype X = { [K in A as `get${K}`]-?: B }\n", "function assertIsString(val: any): asserts val {}\nlet u: undefined | (() => void) = undefined\nif (a < b && c > d) e()\n", "const m = new Map<string, Array<[number, string]>>()\nconst f = g<string>(h)\n", "type Fn = { <T>(x: T): T }\ndeclare const v: string\ndeclare function w(): void\nlet o = { m<T>(x: T): T { return x } }\n",
    ],
    "rs": [
        "pub extern \"C\" fn f() {}\nextern \"C\" { fn g(x: *const u8, ...) -> i32; static X: i32; }\nextern crate a as b;\n", "impl<'a, T: ?Sized + 'a, const N: usize> Tr<T> for [T; N] where T: Fn(&str) -> u8, for<'b> &'b T: Into<u8> { type X = Vec<Vec<T>>; const C: u8 = 1; fn f(self: Box<Self>) -> impl Iterator<Item = &'a T> + '_ { std::iter::empty() } }\n",
        "fn f() -> Result<(), Box<dyn Error + Send>> { let x = match y { Some(1..=5) | None => 1, Foo { a, ref b, .. } if a > 0 => { 2 } [first, .., last] => 3, ref r @ (1 | 2) => *r, -1 => 4, _ => unreachable!() }; Ok(()) }\n",
        "fn main() { let Some(x) = y else { return }; if let Some(a) = b && let Ok(c) = d { } while let Some(p) = s.pop() {} 'o: loop { break 'o; } let z = loop { break 5 }; for (i, v) in x.iter().enumerate() {} }\n", "#![allow(x)]\n#[derive(A, B)]\npub(crate) enum E<T> { A, #[x] B(u8, T), C { a: i32, b: Vec<T>, }, D = 4 }\n",
        "struct U;\nstruct T(pub u8, pub(in a::b) u16);\nunion V { a: u8 }\nstatic mut X: [u8; 3] = [0; 3];\nconst _: () = ();\ntype A<T> = Result<T, E>;\n", "fn c() { let f = move |x: i32, (a, b)| -> i32 { x + a }; let g = || (); g(); let v = vec![1, 2]; println!(\"{}\", v[0] as f32 / 2.); x.0.1 = 3; a..; ..b; a..=b; &mut *c; -d; !e; }\n",
        "macro_rules! m { ($x:expr) => { $x + 1 }; }\nm! { a b c }\nthread_local!(static X: u8 = 1);\n", "use a::{self, b::{c, d as e}, f::*};\nuse ::std::fmt;\nmod x { use super::*; }\nmod y;\n", "async fn f() -> u8 { g().await?.h().await }\nunsafe fn h() {}\npub const unsafe extern \"C\" fn k() {}\n",
        "fn f() { let x = S { a: 1, b, ..Default::default() }; let y = S::<T> { 0: 1 }; let z = <T as U>::V::w(); let q = Vec::<u8>::new(); a::<B>(c); let r = if a { b } else if c { d } else { e }; unsafe { f() }; match x { _ => {} } return; }\n", "trait A: B + 'static { const X: u8; type Y: C<D = E>; fn f(&self) where Self: Sized; fn g(&mut self) {} async fn h(&self); }\n",
        "fn f(x: &'static str, y: &dyn Fn(u8) -> u8, _: (), mut z: [u8; N], &(a, b): &(u8, u8)) -> ! { panic!() }\n", "fn f() { a < b; c >> d; e & f; g | h; i as u8 as u16; x = y; x += 1; x <<= 2; b\"a\"; b'x'; 'y'; r#\"z\"#; 0x1f_u8; 1e-3; 1.0e+5f64; }\n", "impl !Send for X {}\nunsafe impl Sync for X {}\nimpl<T> X<T> { pub fn new() -> Self { Self { } } }\n",
    ],
    "java": [
        "public non-sealed class A extends B {}\nsealed interface C permits A, D {}\nrecord P(int x, List<String> y) implements Q { P { if (x < 0) throw new E(); } static int z = 1; }\n", "class A { long f() { return (long) 1; } Object g() { return (Object) \"x\"; } int h = (int) 'c' + -1; Runnable r = (Runnable & Serializable) () -> {}; }\n",
        "class A<T extends Comparable<? super T> & B> { <U> A(U u) { super(); this.x = u; } Map<String, List<Map<K, V>>> m = new HashMap<>(); int[][] a = new int[3][], b[] = {{1, 2}, {}, }; @Override public String toString() { return a[0][1] + \"x\"; } }\n",
        "class A { void f() { for (int i = 0, j = 1; i < 3; i++, j--) {} for (;;) break; for (final String s : l) x(); do { } while (a); if (a) b(); else if (c) d(); else e(); label: while (true) continue label; synchronized (this) { } assert a : \"b\"; } }\n", "class A { int f(Object o) { return switch (o) { case Integer i when i > 0 -> i; case String s -> { yield 1; } case null, default -> throw new E(); }; } void g(int x) { switch (x) { case 1: case 2: h(); break; default: k(); } } }\n",
        "enum E implements I { A(1) { int f() { return 1; } }, B(2), ; private final int x; E(int x) { this.x = x; } }\nenum F { X, Y }\n", "@interface N { int value() default 1; String[] names() default {}; }\n@N(value = 1, names = {\"a\", \"b\"}) class X {}\n", "class A { void f() throws E, F { try (R r = new R(); s) { } catch (E | F e) { } finally { } Supplier<A> s = A::new; Function<int[], int[]> q = int[]::clone; Comparator.comparing(A::<B>f).reversed(); var x = a -> b -> c; BiFunction<A, B, C> z = (a, b) -> { return a; }; } }\n",
        "package a.b.c;\nimport static a.B.*;\nimport a.C;\npublic abstract class D { protected abstract void f(int... x); static { y = 1; } { z = 2; } class I {} interface J { default void k() {} } native int n(); }\n", "class A { String t = \"\"\"\n  hi \"there\"\n  \"\"\"; Class<?> c = int[].class, d = String.class; boolean b = o instanceof String s && s.isEmpty() || !(o instanceof final Integer i); int e = a ? b : c ? d : e; }\n", "class A { A a = new A() { @Override void f() {} }; int x = y[0]++ + --z; B.C c = this.new C(); int q = (a) + b; int r = (a) - b; long l = 0x1FL >>> 2 >> 1; List<String>[] g; }\n",
    ],
    "go": [
        "package a\n\nfunc f() {\n\tx &^= 1\n\tx, y := 1, \"a\"\n\t_, ok := m[k].(*T)\n\tswitch v := x.(type) {\n\tcase int, []string:\n\t\tf()\n\tcase nil:\n\tdefault:\n\t}\n}\n", "package a\n\nimport . \"fmt\"\n\ntype (\n\tA = B\n\tC[T any, U ~int | ~string] struct {\n\t\tD\n\t\t*e.F\n\t\tx, y int `json:\"x\"`\n\t}\n)\n\nfunc (c *C[T, U]) M(a, b int, rest ...string) (n int, err error) {\n\treturn\n}\n",
        "package a\n\nfunc f() {\nouter:\n\tfor i := 0; i < 3; i++ {\n\t\tfor range ch {\n\t\t\tcontinue outer\n\t\t}\n\t}\n\tfor {\n\t\tbreak\n\t}\n\tfor k, v := range m {\n\t}\n\tif x := g(); x > 1 {\n\t} else if y {\n\t} else {\n\t}\n\tgoto end\nend:\n}\n", "package a\n\nvar x = map[string][]int{\"a\": {1, 2}, \"b\": nil}\nvar y = [...]T{{1}, 2: {3}}\nvar z = &S{A: 1, B: func() int { return 1 }()}\nvar w, v int = 1, 2\nconst (\n\tP = iota\n\tQ\n)\n", "package a\n\nfunc f() {\n\tselect {\n\tcase v := <-c:\n\t\tg(v)\n\tcase d <- 1:\n\tcase <-time.After(1):\n\tdefault:\n\t}\n\tgo func() { h() }()\n\tdefer mu.Unlock()\n\ta[1:2:3] = b[:]\n\t*p = 1\n\tx++\n\tch <- 1\n\t<-ch\n}\n",
        "package a\n\ntype I interface {\n\tio.Reader\n\tM(int) (string, error)\n\t~int | ~string\n}\n\ntype F func(a int, b ...string) func() error\n\nvar c chan<- int\nvar d <-chan int\n", "package a\n\nfunc f[T any](x T) T { return x }\n\nfunc g() {\n\tf[int](1)\n\tb := []byte(\"x\")\n\tc := (*T)(nil)\n\td := interface{}(x).(T)\n\te := struct{ a int }{1}\n\tm := make(map[string]struct{}, 3)\n\tvar h func()\n\t_ = m\n}\n", "package a\n\nfunc f() (int, error) {\n\tif err := g(a,\n\t\tb,\n\t); err != nil {\n\t\treturn 0, fmt.Errorf(\"x: %w\", err)\n\t}\n\ts := a.\n\t\tb().\n\t\tc()\n\treturn s, nil\n}\n", "package a; import \"b\"; func f() { x := 'a'; y := `raw` + \"s\"; {} ; _ = x; _ = y }\n",
    ],
    "c": [
        "int f(int a[static 3], const char *restrict b, void (*cb)(int, void *), ...);\n", "typedef struct node { struct node *next; unsigned x : 3, : 2; union { int a; float b; }; } node_t, *node_p;\nenum e { A, B = 2, C, };\n", "static inline const char *const *g(void) { return (const char *const *)0; }\nint (*fp)(int) = 0, arr[2][3] = {{1, 2, 3}, [1] = {.x = 1}}, *p = &arr[0][0];\n",
        "int main(int argc, char **argv)\n{\n    for (int i = 0; i < argc; ++i) if (argv[i]) puts(argv[i]); else goto end;\n    do { x--; } while (x > 0);\n    switch (x) { case 1: case 2: { break; } default: return 1; }\n    p->a.b[1](2)++;\n    *q = a ? b : c;\n    x = sizeof(int) * sizeof y, z = (struct s){1, 2};\nend:\n    return 0;\n}\n", "int f(a, b) int a; char *b; { return a; }\nmain() { return 0; }\n", "extern int x; struct s; struct t { int a; } v = { 1 }; unsigned long long y = 0x1FULL; double d = 1e-3, e = .5f; char c = '\\'', s[] = \"a\" \"b\";\n", "void f(void) { a * b; foo(bar)(baz); (void)x; ; { } while (1) ; if (a) { } else if (b) ; long long n; size_t m = a * b; T *t = (T *)p; int k, *l; va_arg(ap, int); }\n", "#include <a.h>\n#define X(a) { a\n#if 1\nint x;\n#endif\nstatic int (*handlers[])(void) = { f, g };\nvoid (*signal(int sig, void (*func)(int)))(int);\n", "__attribute__((noreturn)) void f(void);\n_Static_assert(sizeof(int) == 4, \"x\");\nint g(void) { return ({ int y = 1; y; }); }\n",
    ],
    "py": [
        "async def f(a, /, b: int = 1, *args, c, d=2, **kw) -> 'x':\n    async with a as b, c() as (d, e):\n        return await g(*a, **b, c=1)\n", "def f(*, a): pass\ndef g(a=1, *b): return\nlambda *a, k=1, **kw: (yield)\n", "try:\n    x\nexcept* (A, B) as e:\n    raise\nelse:\n    y\nfinally:\n    z\n", "x @= y\n1if y else 2\nwhile 1:\n    break\nelse:\n    pass\n",
        "match x:\n    case 1 | 2 if y: pass\n    case [a, *b] | (c, d): pass\n    case {'k': v, **rest}: pass\n    case A(b=1, c=B()): pass\n    case -1 | 1+2j | None | 'a' 'b': pass\n    case a.b as z: pass\n    case _: pass\n", "match = case = type = 1\nmatch(x)\nprint(match, sep='')\ntype X[T: int, *U] = list[T]\ndef f[T](x: T): ...\nclass A[T](B, metaclass=C): x: int = 1\n",
        "x = [i async for i in y if i for j in k if j if l]\nd = {**a, 'b': 1, **c}\ns = {1, *t}\ng = (i for i in x)\ne = {k: v for k, v in z}\nf(i for i in x)\n", "a, *b = c = d\na[1:2, ::3, ...] = x\n(a.b, c[0]), d = e\na: int\na.b: str = 'x'\na += 1,\nfor x, in y: pass\nfor (a, b) in c: pass\n", "if (n := len(x)) > 1 and not y is not z or a not in b: pass\nelif x: pass\nelse: pass\n", "from . import a\nfrom .a.b import (c as d, e,)\nfrom .. import *\nimport a.b as c, d\nglobal x, y\nnonlocal z\ndel a[0], b.c, (d)\nassert x, 'y'\n", "@a.b(c)\n@d\nclass X: pass\nx = 1; y = 2;\nif x: y; z\n", "with (open(a) as b, open(c) as d,):\n    pass\nwith (a): pass\nwith a, b as c: pass\n", "x = f'{a!r:>{w}} {b[\"c\"]} {{}}' rb'z'\ny = (\n    1,\n    2)\nz = \\\n    3\n", "def f():\n\tif x:\n\t\treturn\n\t# comment\n  # odd comment\n\tyield from g()\n\tx = yield\n\ty = yield 1, 2\n", "return_ = 0xFF_FF + 1e5j + 0b1 + .5 + 5. + 1_000\nx = a if b else lambda: c\nx = not a == b\nx = -a ** -b @ c // d % e << f\n", "class A:\n    '''doc'''\n\n    def f(self): ...\n\n    x = property(lambda self: self.y)\n",
    ],
    "rb": [
        "def f a, b\n  a\nend\n\ndef self.f(a) = a\n\nvalidates :x, if: -> { y }\n", "class A < B::C\n  attr_accessor :a, :b\n  include D\n  def initialize(a, b = 1, *c, d:, e: 2, **f, &g)\n    @a, @b = a, b\n    super()\n  end\n  def ==(o) = o.is_a?(A) && a == o.a\n  def []=(k, v)\n    @h[k] = v\n  end\n  class << self\n    def x; 1; end\n  end\n  private\n  def y?; end\nend\n", "x = if a then b else c end\ny = case z\n    when 1, 2 then :a\n    when String, /x/ then :b\n    else nil\n    end\nreturn unless x\nputs 'a' if b and not c\n", "foo.each_with_index do |x, i|\n  next if x.nil?\n  puts \"#{x[\"a\"]} #{i}\"\nend\nfoo.map { |x| x * 2 }.select(&:even?).reduce(0) { |a, (b, c)| a + b }\n", "begin\n  a\nrescue A, B => e\n  b\nrescue => e then c\nelse\n  d\nensure\n  f\nend\n", "h = { a: 1, 'b' => 2, \"c\": 3, **d, e: }\nfoo a: 1, b: 2 do |x|\n  y\nend\nfoo(:a, *b, **c, &d)\nbar x, y: z\n",
        "s = <<~EOS\n  text ( { [ #{x}\nEOS\nfoo(<<-A, 1)\n  body\n  A\n", "a = b ? c : d\na ||= {}\na&.b&.c = 1\nx, (y, *z) = w\n*a, b = c\ni += 1 while i < 10\nbegin; x; end until y\n", "module A\n  module B::C\n    X = %w[a b].freeze\n    Y = ->(x, y = 1) { x + y }\n    Z = lambda do |x|\n      x\n    end\n  end\nend\n", "loop do\n  break if a || b\nend\nwhile a do b end\nfor i in 1..10 do puts i end\nuntil a\n  b\nend\n", "case x\nin {a: Integer => n, b: [1, *]}\n  n\nin [A, B] | nil\n  y\nelse\n  z\nend\n", "puts [1, 2].sum\nputs -x\nfoo ? bar : baz\nraise ArgumentError, \"x\" unless a =~ /b/\nalias_method :a, :b\nalias c d\np(*a)\nyield x, y\nreturn a, b\n", "a = [\n  1,\n  2,\n]\nfoo(\n  a,\n  b: 1,\n)\nx = a +\n  b\ny = a\n  .b\n  .c { |d| e }\n", "def f(...)\n  g(...)\nend\n__END__\nwhatever ( here\n", "Foo::Bar.new(1)::BAZ\n$stdout.puts :a.to_proc\n@@x = @y[0..-1]\nnot a\n!b\ndefined?(c)\nobj.method :name\nfoo.bar baz, qux do\nend\n", "describe 'x' do\n  it { is_expected.to eq 1 }\n  let(:a) { { b: 1 } }\n  expect { foo }.to raise_error(Bar)\n  before(:each) do end\nend\n", "private def x\n  1\nend\n\ntask default: [:a, :b]\ntask :x => :y do |t|\nend\n",
        'class User < ApplicationRecord\n  has_many :posts, dependent: :destroy\n  validates :email, presence: true, format: { with: /\\A[^@]+@\\w+\\z/ }\n  scope :active, -> { where(active: true) }\n  before_save :downcase_email, if: :email_changed?\n\n  def full_name\n    "#{first_name} #{last_name}".strip\n  end\n\n  def self.search(query)\n    return all if query.blank?\n    where(\'name LIKE ?\', "%#{query}%")\n  end\n\n  private\n\n  def downcase_email\n    self.email = email.downcase\n  end\nend\n',
        "Rails.application.routes.draw do\n  resources :users, only: [:index, :show] do\n    member do\n      get :profile\n    end\n  end\n  root to: 'home#index'\n  get '/a', to: 'b#c', as: :d\nend\n",
        "module Foo\n  class Error < StandardError; end\n  VERSION = '1.0'.freeze\n  DEFAULTS = {\n    host: 'x',\n    port: 80,\n  }.freeze\n\n  class << self\n    attr_writer :config\n    def config\n      @config ||= Config.new\n    end\n  end\n\n  def self.configure\n    yield(config) if block_given?\n  end\nend\n",
        'require \'json\'\nrequire_relative \'../lib/a\'\n\ndata = JSON.parse(File.read(\'x.json\'), symbolize_names: true)\ndata.each_with_object({}) do |(key, value), memo|\n  memo[key] = value.map(&:to_s).sort_by { |x| -x.size }\nend\nputs data.fetch(:a) { |k| "no #{k}" }\nwarn \'x\' unless $PROGRAM_NAME == __FILE__\nexit 1\n',
        'def process(items, limit: 10, &block)\n  items.first(limit).each_slice(2) do |a, b|\n    next unless a && b\n    result = begin\n      block.call(a, b)\n    rescue ArgumentError, TypeError => e\n      logger.error(e.message)\n      nil\n    end\n    puts result if result\n  end\nensure\n  cleanup!\nend\n',
        "x = if a > 1\n  :big\nelsif a == 1\n  :one\nelse\n  :small\nend\n\ny = case\n    when a < 0 then -1\n    else 1\n    end\n\nz = a > 0 ? 'pos' : 'neg'\nw = [1, 2, 3]\n  .map { |i| i * 2 }\n  .reject(&:zero?)\n\nunless x.nil? || y.nil?\n  foo(x, y)\nend\n",
        "describe Foo do\n  let(:foo) { described_class.new(a: 1) }\n  context 'when x' do\n    it 'does y' do\n      expect(foo.bar).to eq(2)\n      expect { foo.baz }.to change { foo.count }.by(1)\n      expect(foo).to have_received(:x).with(hash_including(a: 1))\n    end\n  end\n  subject(:s) { foo }\n  it { is_expected.to be_valid }\nend\n",
        'def fib(n)\n  n < 2 ? n : fib(n - 1) + fib(n - 2)\nend\nputs fib(10)\nputs "%d %s" % [1, \'a\']\nprintf("%d\\n", 3)\n(1..10).step(2) { |i| print i, \' \' }\n1.upto(5) { puts _1 }\na, b = b, a\nh = Hash.new { |hash, k| hash[k] = [] }\nh[:x] << 1\nh.dig(:a, :b)&.c\n',
        "loop do\n  line = gets or break\n  case line.chomp\n  when /^quit/i\n    break\n  when 'a'..'f', Integer\n    redo\n  end\nend\nwhile (x = queue.shift)\n  puts x\nend\nuntil done? do step end\nbegin\n  tries += 1\n  connect\nrescue Timeout::Error\n  retry if tries < 3\n  raise\nend while false\n",
        'class Stack\n  include Enumerable\n  def initialize = @items = []\n  def push(item)\n    @items.push item\n    self\n  end\n  alias << push\n  def each(&)\n    @items.each(&)\n  end\n  def [](i) = @items[i]\n  def to_s = "Stack(#{@items.join(\', \')})"\n  def <=>(other)\n    size <=> other.size\n  end\n  def -@\n    self.class.new\n  end\n  def method_missing(name, *args, **opts, &blk)\n    super\n  end\n  def respond_to_missing?(name, include_private = false) = true\nend\n',
        'task :build, [:target] => [:clean] do |t, args|\n  sh "make #{args[:target] || \'all\'}"\nend\nGem::Specification.new do |s|\n  s.name = \'x\'\n  s.files = Dir[\'lib/**/*.rb\'] + %w[README.md LICENSE]\n  s.add_dependency \'y\', \'~> 1.0\', \'>= 1.0.2\'\nend\n',
        'text = <<~HTML\n  <a href="#{x}">\n    it\'s (fine\n  </a>\nHTML\nputs text.gsub(/\\s+/, \' \')\nsql = <<-SQL.strip\n  select * from t where a = \'b\'\n  SQL\nfoo(<<~A, <<~B)\n  one\nA\n  two\nB\nvalue = obj.try(:name) || default\nraise NotImplementedError, "#{self.class} must implement"\nthrow :done, 1\ncatch(:done) { 2 }\n',
        'Point = Struct.new(:x, :y) do\n  def dist = Math.sqrt(x**2 + y**2)\nend\np Point.new(1, 2).dist\nputs [*1..3, *[4]].inspect\nadd = proc { |a, b = 2| a + b }\nadd.(1)\nadd[1]\nm = 5.method(:+)\nputs (1 + 2) * 3\nputs(-1.abs)\nprint "a" "b"\ni = 0x1f + 0b11 + 1_000 + 1e3\n',
        'if x then y end\nfoo if a and not b or c\nreturn if x\nreturn x, y if z\nyield\nyield a, b\nsuper\nsuper(a)\nsuper a, b: 1\nself.a ||= 1\nself[:x] = 1\na.b.c += 1\nA::B.c\n::D\ndefined?(@x) && @x\n!a.b?\nnot(a)\nalias_method :a, :b\nundef_method :c\n',
    ],
}

BROKEN = {
    "js": [
        "let = = 3;\n", "function (a b) {}\n", "() = 5;\n", "const = 5;\n", "foo() bar();\n", "try {}\n", "if a { b }\n", "for (let i = 0; i < 3) {}\n", "let x = ;\n", "x = [1, 2\n", "var a b;\n", "function f( { }\n", "class A { x = }\n", "return => 1;\n", "a +* b;\n", "if (a) else b;\n", "switch (a) { foo: 1, }\n", "switch (a) { b(); }\n", "const x;\n", "import { a from 'b';\n", "import a 'b';\n", "export default;\n", "x = { a: 1 b: 2 };\n", "f(a b);\n", "f(a,, b);\n", "new;\n", "a.;\n", "a..b;\n", "let x = 'abc;\n", "x = `abc ${;\n", "while () {}\n", "do { } (x);\n", "catch (e) {}\n", "else { }\n", "case 1: a;\n", "class { foo }\nclass A extends { }\n", "let [a, b = c;\n", "x = a ? b;\n", "x = y z;\n", "async function f { }\n", "=> a;\n", "function f() { return }}\n", "const f = (a, => a;\n", "throw;\n", "var 1x = 2;\n", "a = b = ;\n", "@@a\nx\n", "{ a: 1, b: 2 }}\n", "for x in y {}\n", "let a = 1,;\n",
    ],
    "ts": ["let x: = 1;\n", "let x: number string = 1;\n", "interface A { b: }\n", "interface { a: string }\n", "type A string;\n", "enum { A }\n", "enum E { A B }\n", "function f(a: ): void {}\n", "let x = a as ;\n", "type A = | ;\n", "function f<T(x: T) {}\n", "let t: [string, number = 1;\n", "abstract A { }\n", "class A implements { }\n", "let f = (a: number): => a;\n", "const x: Map<string, = 1;\n", "foo() bar();\n", "import type from;\n"],
    "rs": [
        "match x { 1 => }\n", "fn f() { x + }\n", "fn f() { match x { 1 => } }\n", "fn f( { }\n", "fn f() -> { }\n", "fn () {}\n", "let x = 1;\n", "fn f() { let = 1; }\n", "fn f() { let x 1; }\n", "fn f() { if { } else }\n", "fn f() { else { } }\n", "struct S { a: u8 b: u8 }\n", "struct S { a }\n", "enum E { A B }\n", "impl { }\n", "impl A for { }\n", "use a::;\n", "use a::b\nfn f() {}\n", "fn f(a) {}\n", "fn f(a: u8 b: u8) {}\n", "fn f() { foo() bar() }\n", "fn f() { for in x { } }\n", "fn f() { x.; }\n", "fn f() { a b c; }\n", "fn f() { let x = ; }\n", "pub fn f() { return 1 2; }\n", "fn f() { (1, 2; }\n", "fn f() { Foo { a: 1 b: 2 }; }\n", "mod;\n", "trait { }\n", "const X = ;\n", "static X u8 = 1;\n", "fn f<T { }\n", "fn f() { while { x } { } y z }\n", "fn f() { let x: = 1; }\n", "fn f() { x = = 1; }\n", "type A = ;\n", "fn f() { |x y| 1; }\n", "fn f() { a =>  b; }\n", "struct S(u8, ;\n",
    ],
    "java": [
        "class A { int x }\n", "foo() }\n", "class A { void f() { foo() bar(); } }\n", "class A { void f() { int = 1; } }\n", "class A { void f() { x + 1; } }\n", "class { }\n", "class A { void f( { } }\n", "class A { void f() { if x { } } }\n", "class A { void f() { for (int i = 0; i < 3) { } } }\n", "class A { void f() { return 1 } }\n", "class A { f() { } int; }\n", "class A extends { }\n", "import a.b\nclass A { }\n", "package;\n", "class A { void f() { try { } } }\n", "class A { void f() { else { } } }\n", "class A { void f() { a b c; } }\n", "class A { int[] x = {1 2}; }\n", "class A { void f(int a int b) { } }\n", "class A { void f() { g(a b); } }\n", "class A { void f() { g(a,); } }\n", "class A { void f() { switch (x) { foo(); } } }\n", "class A { void f() { new; } }\n", "class A { void f() { x = ; } }\n", "class A { void f() { String s = 'ab; } }\n", "class A { private int x = 1, ; }\n", "class A { Map<String, x; }\n", "enum E { A B }\n", "class A { void f() { while () { } } }\n", "class A { void f() { do { } } }\n", "class A { void f() { throw; } }\n", "int f() { return 1; }}\n", "class A { void f() { a ? b; } }\n", "class A { public void int f() { } }\n", "class A { void f() { 5; } }\n", "class A { foo(); }\n", "interface I { void f() }\n", "class A { void f() { x.; } }\n", "class A { void f() { (a; } }\n",
    ],
    "go": [
        "package a\n\nfunc f() {\n\tx := }\n", "package a\n\nfunc f() int {\n\tfoo() bar()\n}\n", "package a\n\nfunc f( {\n}\n", "func f() {}\n", "package a\n\nfunc f() {\n\tif x\n\t{\n\t}\n}\n", "package a\n\nfunc f() {\n\tvar x =\n}\n", "package a\n\nvar x int string\n", "package a\n\nimport fmt\n", "package a\n\ntype T struct {\n\ta int b int\n}\n", "package a\n\nfunc f() {\n\tfor i := 0; i < 3 {\n\t}\n}\n", "package a\n\nfunc f() {\n\treturn 1 2\n}\n", "package a\n\nfunc f() {\n\ta b c\n}\n", "package a\n\nfunc f() {\n\telse {\n\t}\n}\n", "package a\n\nfunc f() {\n\tx = [1, 2]\n}\n", "package a\n\nx := 1\n", "package a\n\nfunc f() {\n\tswitch x {\n\t\tfoo()\n\t}\n}\n", "package a\n\nfunc f() {\n\tg(a b)\n}\n", "package a\n\nfunc f() {\n\tx := map[string]{}\n}\n", "package a\n\nfunc f() {\n\tg(\n\t\ta\n\t)\n}\n", "package a\n\nfunc {\n}\n", "package a\n\nfunc f() {\n\tx ==\n}\n", "package a\n\nfunc f() {\n\tdefer\n}\n", "package a\n\nfunc f() {\n\tx.\n}\n", "package a\n\nfunc f() {\n\tif {\n\t}\n}\n", "package a\n\nfoo()\n", "package a\n\nfunc f() { x++ y++ }\n", "package\n", "package a\n\ntype T\n", "package a\n\nconst = 1\n", "package a\n\nfunc f() {\n\tx = y = z\n}\n",
    ],
    "c": [
        "int f(int a int b) {}\n", "int f( { }\n", "int x = ;\n", "int x y z;\n", "void f() { foo() bar(); }\n", "void f() { if x { } }\n", "void f() { for (i = 0; i < 3) { } }\n", "void f() { return 1 }\n", "void f() { else { } }\n", "struct s { int a }\n", "struct s { int a; }\nint main() { }\n}\n", "int a[3 = {1};\n", "void f() { int = 1; }\n", "void f() { x + ; }\n", "void f() { g(a b); }\n", "void f() { g(a,,b); }\n", "void f() { switch { } }\n", "void f() { do { } }\n", "void f() { while () { } }\n", "int main() { return 0; \n", "void f() { a b c; }\n", "void f() { case; }\n", "enum { A B };\n", "enum e { A = };\n", "char *s = \"abc;\n", "void f() { x = y z; }\n", "void f() { p->; }\n", "int f(int, ) { }\n", "typedef;\nint int_ = = 2;\n", "void f() { goto; }\n", "void f() { (a; }\n", "int x\nint y;\n", "return 0;\n", "if (x) { }\n", "void f() { a ? b; }\n", "int a = {1, 2;\n", "x = = 1;\n", "void f() { 1 = = 2; }\n",
    ],
    "py": [
        "x = = 1\n", "def f(:\n    pass\n", "def f()\n    pass\n", "if x\n    pass\n", "if x:\npass\n", "x = (1, 2\n", "x = 1 2\n", "print x\n", "for x y: pass\n", "class: pass\n", "return = 1\n", "def f(a=1, b): pass\n", "f(a=1, b)\n", "else:\n    x\n", "try:\n    x\n", "  x = 1\n y = 2\n", "x = [1, 2\ny = 3\n", "import\n", "from x import\n", "x = {1: 2, 3}\n", "lambda x y: 1\n", "def f(*): pass\n", "1 = x\n", "f() = 1\n", "a b\n", "x = 'abc\n", "while: pass\n", "with open(x) as: pass\n", "@\ndef f(): pass\n", "x +\n", "not\n", "assert\n", "del\n", "async x\n", "except:\n    pass\n", "x = y if z\n", "def 1f(): pass\n", "[x for]\n", "x ? y : z\n", "x++\n", "a = b = \n", "if x:\n    y\n  else:\n    z\n", "class A:\ndef f(self):\n    pass\n",
    ],
    "rb": [
        "def f(\n  1\nend\n", "class a\nend\n", "def f\n  1\n", "x = \n)\n", "if x\n  y\n", "end\n", "x = [1, 2\n", "foo(a,, b)\n", "{ a: 1 b: 2 }.x\n", "def 1f\nend\n", "class\nend\n", "x = = 1\n", "else\n  y\nend\n", "case x\n  foo\n  when 1 then 2\nend\n", "a +\n", "x do |a, b\n  y\nend\n", "def f(a b)\n  a\nend\n", "puts 'a\n", "module\n  x\nend\n", "when 1\n  x\n", "begin\n  a\nrescue\n  b\n", "x = {a => }\n", "1 2\n", "a. \n)\n", "foo.each { |x| y\n", "unless\n  x\nend\n", "return return_ if\n", "x y z 1 2\n", "@ = 1\n", "]\n", "x = (1 + \n2\n", "class A <\nend\n", "5 = x\n", "yield = 1 =\n",
    ],
}
